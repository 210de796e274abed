import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netloom.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>"


def nearest(spark, rows, k=20, m=20):
    return [tuple(r) for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % m == 0, k).orderBy("query_id", "rank").collect()]


def exact(ids, x, q, k):
    score = (x * x[q]).sum(1)
    order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
    return [(int(ids[i]), float(score[i])) for i in order]


def test_recall_against_brute_force(spark):
    d = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, x = t.vec_id.to_numpy(), np.stack(t.embedding).astype(float)
    place = {i: n for n, i in enumerate(ids.tolist())}
    found: dict[int, list] = {}
    for r in queries.op2_ann(spark, d).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, rows in found.items():
        assert [r[0] for r in rows] == list(range(1, 21)) and rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        assert np.allclose([r[2] for r in rows], (x[[place[r[1]] for r in rows]] * x[place[q]]).sum(1), rtol=0, atol=1e-12)
        hits += len({r[1] for r in rows} & {i for i, _ in exact(ids, x, place[q], 20)})
    assert hits >= 0.95 * 20 * len(found)


def clouds():
    rng = np.random.default_rng(7)
    gauss = rng.standard_normal((6000, 32))
    centres = rng.standard_normal((20, 32))
    yield "gaussian", gauss
    yield "clustered", centres[rng.integers(0, 20, 6000)] + 0.3 * rng.standard_normal((6000, 32))
    yield "skewed norms", gauss * rng.lognormal(0, 0.7, (6000, 1))


@pytest.mark.parametrize("name,x", list(clouds()), ids=lambda v: v if isinstance(v, str) else "")
def test_recall_over_several_shards(spark, monkeypatch, name, x):
    monkeypatch.setattr(ann, "SHARD_ROWS", 1500)
    monkeypatch.setattr(ann, "QUERY_GROUP", 40)
    x = x.astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    found: dict[int, set] = {}
    for r in ann.nearest(df, F.col("vec_id") % 60 == 0, 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(found) == 100
    hits = sum(len(rows & {i for i, _ in exact(np.arange(len(x)), x.astype(float), q, 20)}) for q, rows in found.items())
    assert hits >= 0.95 * 20 * len(found)


def test_widening_stops_before_the_whole_shard():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32))
    x = centres[rng.integers(0, 40, 4000)] + 0.05 * rng.standard_normal((4000, 32))
    x /= np.sqrt((x * x).sum(1))[:, None]
    shard = ann.Shard(np.arange(4000), x, float(np.sqrt((x * x).sum(1).max())))
    seen = []
    shard.single = type("Counted", (), {"__getitem__": lambda self, at, a=shard.single: seen.append(len(at)) or a[at], "__matmul__": lambda self, v, a=shard.single: seen.append(4000) or a @ v})()
    list(shard.search(x[:10], np.arange(10), 20))
    assert sum(seen) < 0.2 * 10 * 4000


def test_vectors_of_another_length_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [3.0]), (3, [1.0, 2.0, 3.0])]
    assert nearest(spark, rows, 5, 20) == [(0, 1, 1, 1.0)]


def test_few_candidates_ties_and_bad_vectors(spark):
    bad = [(40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [1.0, None]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (120, [])]
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (3, [1.0, 0.5]), (6, [1.0, 1.0]), (7, [1.0, 1.0]), *bad]
    assert nearest(spark, rows) == [(0, 1, 3, 1.0), (0, 2, 6, 1.0), (0, 3, 7, 1.0), (0, 4, 20, 0.0), (20, 1, 6, 2.0), (20, 2, 7, 2.0), (20, 3, 3, 1.0), (20, 4, 0, 0.0)]


def test_many_copies_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 64)
    rng = np.random.default_rng(1)
    hot = rng.standard_normal(8).round(2).tolist()
    rows = [(i, hot if i % 2 else rng.standard_normal(8).round(2).tolist()) for i in range(400)]
    got = nearest(spark, rows, 5, 25)
    ids, x = np.arange(400), np.array([r[1] for r in rows], np.float32).astype(float)
    for q in range(25, 400, 50):  # queries among the copies: the copies of the smallest ids tie
        want = [i for i, s in exact(ids, x, q, 400) if s >= (x[q] * x[q]).sum() - 1e-12][:5]
        assert [r[2] for r in got if r[0] == q and r[3] >= (x[q] * x[q]).sum() - 1e-12][: len(want)] == want


def test_empty_table_and_extra_columns(spark):
    assert nearest(spark, []) == []
    df = spark.createDataFrame([(0, [1.0], "s", 1), (1, [2.0], "t", 2)], "vec_id long, embedding array<float>, shard string, vector int")
    assert [tuple(r) for r in ann.nearest(df, F.col("vec_id") == 0, 3).collect()] == [(0, 1, 1, 2.0)]
