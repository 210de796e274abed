import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import ngram_join as nj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k=4, percent=85):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    inverted, shared = collections.defaultdict(list), collections.Counter()
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    for v in inverted.values():
        shared.update((a, b) for n, b in enumerate(v) for a in v[:n])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, shared, rows = words(120), words(50), []
    for i in range(50):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else "\n".join(w)))
    rows += [(i, " ".join(words(rng.randrange(0, 30)) + shared + words(rng.randrange(0, 30)))) for i in range(100, 160)]
    rows += [(i, " ".join(words(rng.randrange(0, 4)))) for i in range(200, 215)]
    for i in range(300, 360):
        w = rng.choice(rows)[1].split()
        if w and rng.random() < 0.7:
            w[rng.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w)))
    return rows + [(900, None), (901, ""), (902, "a b"), (903, "A B"), (904, "a a a a a a a")]


@pytest.mark.parametrize("limits", [{}, {"CHUNK": 16}, {"CHUNK_TOKENS": 900}, {"RARE_MEMBERS": 3, "BEFORE": 2}, {"HOT_SHARE": 5, "OUT_TOKENS": 50}])
def test_against_brute_force(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(nj, k, v)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in nj.report(df).collect()} == brute(rows)


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "a", 1), (2, text, "b", 2), (2, text, "b", 2), (3, "other words here today", "c", 3), (3, "other words here today", "c", 3), (4, None, None, None), (5, "", "d", 5), (None, "free standing words of no id", "e", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, count int")
    got = nj.first_of_each(df).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, 1, 3, 4, 5] and got[0].__fields__ == df.columns


def test_texts_without_id_and_texts_of_one_id(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(None, a), (None, a), (None, a + " x"), (5, b), (5, "another text under the same id"), (5, "another text under the same id"), (6, b + " y"), (None, b)]
    got = nj.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text[:2]) for r in got) == [(0, "w0"), (5, "an"), (5, "v0")]


def test_links_of_each_document(spark):
    rows = corpus()
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        sets[i] = frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    linked = lambda a, b: bool(a) and 100 * len(a & b) >= 85 * len(a | b)
    want = {i: sum(linked(s, t) for j, t in sets.items() if j != i) for i, s in sets.items()}
    got = nj.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.n_links for r in got} == want
    assert all(r.class_id == min(j for j, t in sets.items() if t == sets[r.doc_id]) for r in got if sets[r.doc_id])


def test_a_very_long_text_in_near_copies(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(50000)}" for _ in range(100_000)]
    rows = [(i, " ".join([*words[: 1000 * i], "zz", *words[1000 * i :]])) for i in range(10)] + [(20, " ".join(words[:70_000]))]
    assert {r.doc_id: r.component_id for r in nj.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()} == {**dict.fromkeys(range(10), 0), 20: 20}


def test_tokens_ahead_are_bounded(monkeypatch):
    monkeypatch.setattr(nj, "BEFORE", 4)
    t = np.arange(1, 30, dtype=np.uint64) * np.uint64(77)
    got = [set(np.frombuffer(b, np.uint64).tolist()) for b in nj.earlier(t)]
    place = dict(zip(t.tolist(), nj.T.mix(t ^ np.uint64(0x5BD1E995)).tolist(), strict=True))
    assert got == [set(sorted(t[:i].tolist(), key=place.get)[:4]) for i in range(len(t))]


def test_empty_table(spark):
    assert nj.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_and_null_ids(spark):
    rows = [(7, "a b c d e"), (7, "a b c d e"), (None, "A B C D E"), (None, None)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in nj.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 0, -1), (-1, 2, 7), (7, 2, 7), (7, 2, 7)]


def test_filter_of_wanted_documents_holds_none_back(spark):
    wanted = spark.createDataFrame([(i if i % 5 else None, i * 7919) for i in range(500)], "id long, tie long")
    others = spark.createDataFrame([(i, -i) for i in range(1, 500)], "id long, tie long")
    bits = nj.filter_of(wanted)
    assert bits.nbytes == (1 << nj.WANTED_BITS) // 8

    def let_through(rows):
        place = np.array([r["p"] for r in rows.select(nj._place().alias("p")).collect()])
        at = place // nj.WANTED_BLOCKS
        return bits[place % nj.WANTED_BLOCKS, at >> 3] >> (7 - (at & 7)) & 1

    assert let_through(wanted).all() and let_through(others).mean() < 0.01


def test_texts_are_not_shuffled_for_their_sets(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f g h i {i % 3}") for i in range(30)], "doc_id long, text string")
    texts = nj._texts(docs)
    sent = spark.sparkContext.broadcast(nj.filter_of(texts.select("id", "tie").where("id = 4")))
    sets = texts.select(nj._place().alias("place"), "text").mapInArrow(nj._whole_sets(4, sent), "key long, items binary")
    assert sets.count() == 1 and "Exchange" not in sets._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("places", [None, 97])
def test_first_of_each_shuffles_no_texts_that_a_place_decides(spark, monkeypatch, places):
    """With few places most hold documents that go and others that stay; both ways keep the same rows."""
    if places:
        monkeypatch.setattr(nj, "_place", lambda of="": F.pmod(F.xxhash64(of + "id", of + "tie"), F.lit(places)))
    names = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*names, str(i // 3)]) if i % 2 else f"{i} one of its own {i * 31} here") for i in range(300)] + [(7, None), (8, ""), (9, ""), (301, "a b c d e f"), (301, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {}
    monkeypatch.setattr(nj, "stored", lambda df, name, f=nj.stored: kept.setdefault(name, f(df, name)) if name == "join_unsure" else f(df, name))
    got = nj.first_of_each(docs, 4, 80)
    ids = sorted(r.doc_id for r in got.collect())
    assert ids == sorted([1, *range(0, 300, 2), 7, 8, 9, 301])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    unsure = kept["join_unsure"].count()
    assert unsure > 20 if places else unsure <= 6


def test_bitmaps_differ_in_no_more_places_than_sets_do():
    rng = np.random.default_rng(3)
    for _ in range(300):
        both, a, b = (rng.integers(0, 1 << 63, int(rng.integers(0, m)), dtype=np.uint64) for m in (400, 60, 300))
        x, y = np.union1d(both, a), np.union1d(both, b)
        assert nj.apart(nj.parity(x), nj.parity(y)) == nj.apart(nj.parity(y), nj.parity(x)) <= len(np.setxor1d(x, y))
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    assert nj.apart(nj.parity(x), nj.parity(x)) == 0 and nj.apart(nj.parity(x), nj.parity(x + np.uint64(7))) > 100


def half_alike():
    """Ten groups of nine documents; those of a group share half their words, and the first two almost all."""
    rng = random.Random(9)
    words = lambda n: [f"v{rng.randrange(1 << 40)}" for _ in range(n)]
    rows = []
    for g in range(10):
        shared = words(150)
        rows += [(10 * g + i, " ".join(shared + words(75))) for i in range(9)]
        rows[-8] = (10 * g + 1, rows[-9][1] + " more")
    return rows


def test_sets_are_shipped_only_for_pairs_that_may_be_links(spark, monkeypatch):
    held = {}

    def kept(df, name, store=nj.stored):
        held.setdefault(name, []).append(out := store(df, name))
        return out

    monkeypatch.setattr(nj, "stored", kept)
    monkeypatch.setattr(nj, "discard", lambda df: None)
    rows = half_alike()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in nj.report(df).collect()} == brute(rows)
    assert held["join_sets"][0].count() == 20  # of 90, all of which are candidates
    assert held["join_pairs"][0].count() == 10


def test_verification_in_steps(spark, monkeypatch):
    df = spark.createDataFrame(corpus() + [(i + 1000, t) for i, t in half_alike()], "doc_id long, text string").repartition(3)
    whole = sorted(tuple(r) for r in nj.joined(df).collect())
    steps = []

    def kept(df, name, store=nj.stored):
        steps.append(name)
        return store(df, name)

    monkeypatch.setattr(nj, "stored", kept)
    monkeypatch.setattr(nj, "SETS_AT_A_TIME", 40_000)
    assert sorted(tuple(r) for r in nj.joined(df).collect()) == whole
    assert steps.count("join_links") > 5
