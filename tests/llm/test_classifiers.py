import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from netloom.llm import linear, quality_classifier, quality_rules, toxicity
from netloom.functions.store import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize(("module", "column", "held", "least"), [(toxicity, "toxic", lambda c: c % 5 == 0, 0.9), (quality_classifier, "quality", lambda c: c % 3 == 1, 0.93)])
def test_held_out_accuracy(spark, module, column, held, least):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = module.report(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == held(zlib.crc32(str(r.doc_id).encode())) for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.predicted == r[column] for r in test) >= least * len(test)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxic_words_are_caught_and_clean_texts_left(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = toxicity.fit(docs, labels)
    clean = docs.join(labels.where("toxic = 0 AND quality = 1"), "doc_id").select("doc_id", "text").limit(300)
    toxic = clean.withColumn("text", F.concat("text", F.lit(" you idiot, what a worthless TRASH clown and moron!")))
    share = lambda df: toxicity.score(df, model).agg(F.avg((F.col("score") >= 0.5).cast("int"))).first()[0]
    assert share(clean) <= 0.01 and share(toxic) >= 0.99


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_edges(spark, module):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "x " * 30000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    rows = module.report(docs, labels).collect()
    assert len(rows) == 5 and all(r.score is not None for r in rows)
    none = module.report(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert module.report(docs.limit(0), labels).collect() == []


def grams_of(text, f):
    """The n-grams and skip-grams of a text, as tuples."""
    words = WORD.findall(text or "")
    if f.lower:
        words = [w.lower() for w in words]
    if f.trim:
        words = [re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", w) or w for w in words]
    out = set()
    for k in f.orders:
        for i in range(len(words) - k + 1):
            g = tuple(words[i : i + k])
            out.add((k, "same") if f.repeats and k > 1 and len(set(g)) == 1 else (k, g))
    return out | {("skip", words[i], words[i + gap]) for gap in f.skips for i in range(len(words) - gap)}


def ftrl_scores(docs, labels, module):
    """FTRL-proximal over dictionaries, in the order of the hashed ids."""
    a, b, l1, l2 = (module.RATES[x] for x in ("alpha", "beta", "l1", "l2"))
    z, n = collections.Counter(), collections.Counter()

    def weight(x):
        least = 0 if x == "bias" else l1
        return 0.0 if abs(z[x]) <= least else -(z[x] - math.copysign(least, z[x])) / ((b + math.sqrt(n[x])) / a + l2)

    score = lambda text: 1 / (1 + math.exp(-sum(weight(x) for x in [*grams_of(text, module.FEATURES), "bias"])))
    for _ in range(module.EPOCHS):
        for i in sorted(labels, key=linear.in_order):
            every = [*grams_of(docs[i], module.FEATURES), "bias"]
            w = {x: weight(x) for x in every}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[i]
            for x in every:
                z[x] += g - (math.sqrt(n[x] + g * g) - math.sqrt(n[x])) / a * w[x]
                n[x] += g * g
    return {i: score(t) for i, t in docs.items()}


@pytest.mark.parametrize(("module", "column", "fold", "held"), [(toxicity, "toxic", 5, 0), (quality_classifier, "quality", 3, 1)])
def test_scores_against_plain_python(spark, module, column, fold, held):
    rng = random.Random(2)
    vocabulary = ["good", "plain", "Tale,", "of", "a", "river", "and", "(hill)"]
    docs, marks = {}, {}
    for i in range(120):
        bad = i % 3 == 0
        docs[i] = " ".join(rng.choice([*vocabulary, *(["vile", "Scum!", "scum"] if bad else [])]) for _ in range(rng.randrange(1, 15)))
        marks[i] = int(bad)
    docs |= {200: "", 201: "a a a a a a", 202: None}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y, y) for i, y in marks.items()], "doc_id long, quality int, toxic int")
    crc = lambda i: zlib.crc32(str(i).encode()) % fold
    want = ftrl_scores(docs, {i: y for i, y in marks.items() if crc(i) != held}, module)
    got = {r.doc_id: r.score for r in module.report(df, labels).collect()}
    assert got == pytest.approx(want, abs=1e-5) and len({round(x, 3) for x in want.values()}) > 10


def test_labels_of_other_documents_do_not_fill_the_sample(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id")).alias("text"))
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    assert linear.labelled(docs, labels, "toxic", None, 100).count() == 50
    assert linear.labelled(docs.union(docs), labels, "toxic", None, 20).count() == 20


def test_bytes_of_examples_are_bounded(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.expr("cast(repeat('x', cast(if(id = 7, 90, 10) as int)) as binary)").alias("at"))
    kept = linear.bounded(rows, F.length("at"), 5000).collect()
    assert len(kept) == 99
    kept = linear.bounded(rows, F.length("at"), 1000).collect()
    assert 90 <= len(kept) <= 100 and 7 not in {r.doc_id for r in kept}


write = DataFrame.write


@pytest.mark.parametrize("module", [toxicity, quality_classifier, quality_rules])
def test_training_writes_no_table_and_leaves_nothing_cached(spark, monkeypatch, module):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id")).alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), *((F.col("id") % 2).cast("int").alias(x) for x in ("quality", "toxic")))
    written = []
    monkeypatch.setattr(DataFrame, "write", property(lambda df: written.append(df) or write.fget(df)))
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    module.fit(docs, labels)
    assert written == []
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= cached


def test_a_column_of_the_score_gives_way(spark):
    docs = spark.createDataFrame([("x", "a b c", 3)], "Score string, text string, n_words int")
    model = linear.trained([], toxicity.FEATURES)
    assert linear.with_score(docs, model, "score").columns == ["text", "n_words", "score"]
    assert quality_rules.judged(docs, None).first().n_words == 3


def test_character_grams_are_of_code_points():
    import numpy as np

    buf = np.frombuffer("aé中😀".encode(), np.uint8)
    word, at = quality_rules.char_grams(buf, np.array([len(buf)]))
    assert len(word) == 3 + 2 and len(set(at.tolist())) == 5
    start, value = quality_rules.T.points(buf)
    assert start.tolist() == [0, 1, 3, 6] and value[2] == int.from_bytes("中".encode(), "big")


def test_ftrl_keeps_few_weights():
    f = linear.Ftrl(50, alpha=1.0, l1=1.0, l2=0.1)
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(400):
        at = np.append(rng.choice(np.arange(2, 50), 5, replace=False), 50)
        y = int(rng.random() < 0.5)
        at = np.append(at, y)
        f.learn(at, np.ones(len(at)), y)
    w = f.weights()
    assert w[1] > 1 > -1 > w[0] and (w[2:50] == 0).sum() > 24


def counted(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = [False] * len(w)
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            cover[i : i + 5] = [True] * 5
    n, r = len(w), sum(cover)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, r, n < 10 or 100 * r > 20 * n


def test_quality_rules_against_brute_force(spark, sf_dir):
    extra = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "\n\n \n"), (10**6 + 3, "x\nx\n x\nx"), (10**6 + 4, "a b c d e " * 20), (10**6 + 5, "é ü #* $% \n" * 3), (10**6 + 5, "é")]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = quality_rules.report(docs, table(spark, sf_dir, "labels")).collect()
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(counted(r.text))
    got = collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
        assert r.kept == (not r.base_failed and r.quality >= 0.5)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}


def test_quality_rules_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in quality_rules.report(docs, labels).collect()] == [True]
    assert quality_rules.report(docs.limit(0), labels).collect() == []
