import hashlib
import random
import re

import pytest

from netloom.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    first, out = {}, {}
    docs = [(i, WORD.findall(t or "")) for i, t in sorted(rows, key=lambda r: r[0])]
    for i, w in docs:
        for p in range(len(w) - k + 1):
            first.setdefault(tuple(w[p : p + k]), (i, p))
    for i, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] != (i, p):
                gone[p : p + k] = [True] * k
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def reported(spark, rows, k=20):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sd.report(df, k).collect()}


def passages(seed=1):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    shared = [text(60) for _ in range(4)]
    rows = [(i, text(rng.randrange(0, 40)) + "\t" + rng.choice(shared)[rng.randrange(0, 30) :] + "\n" + text(20) + rng.choice(shared)) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "w " * 90), (103, "a b " * 80), (104, "a b " * 80), (105, rows[3][1])]


@pytest.mark.parametrize(("hot", "sample"), [(4000, {}), (3, {}), (3, {"SAMPLE": 1, "SAMPLE_LEAST": 1, "HOT_SHARE": 10**9}), (4000, {"SAMPLE": 1, "SAMPLE_LEAST": 2, "HOT_SHARE": 10**9})])
def test_against_brute_force(spark, monkeypatch, hot, sample):
    for name, value in {"HOT": hot, **sample}.items():
        monkeypatch.setattr(sd, name, value)
    rows = passages()
    assert reported(spark, rows) == brute(rows, 20)


def test_small_alphabet(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 90)))) for i in range(50)]
    assert reported(spark, rows, 8) == brute(rows, 8)


def test_repeated_rows_count_as_one_document(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in sd.report(df).collect())
    assert got == [(-1, 0), (1, 0), (1, 0), (2, 30)]


def test_empty_table(spark):
    assert sd.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_removed_keeps_columns_and_the_rest_of_the_text(spark):
    body = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, body, 5, 9, "m"), (2, "head\n" + body + "\ttail", 5, 9, "n"), (3, None, None, 0, None)], "doc_id long, text string, n_chars long, id long, marks string")
    got = {r.doc_id: r.asDict() for r in sd.removed(df).collect()}
    assert got[1]["text"] == body and got[1]["n_chars"] == 5
    assert got[2]["text"] == "head\ntail" and got[2]["n_chars"] == 9 and got[2]["marks"] == "n" and got[2]["id"] == 9
    assert got[3]["text"] is None


def test_automaton_matching_statistics():
    rng = random.Random(3)
    for _ in range(50):
        seqs = [[rng.choice("ab") for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        a = sd.SuffixAutomaton()
        for s in seqs:
            a.add(s)
        q = [rng.choice("abc") for _ in range(15)]
        subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i, len(s) + 1)}
        want = [max(n for n in range(i + 2) if tuple(q[i + 1 - n : i + 1]) in subs) for i in range(len(q))]
        assert a.matches(q) == want


def test_a_very_long_text(spark):
    words = [f"w{i % 4999}x{i // 7}" for i in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[50_000:50_400], "end"]))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in sd.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (120_000, 0), 2: (401, 400)}
