import duckdb
import pytest

from netloom.llm import mixing, queries


def targets(rows, weights=(5, 2, 1), cap=3):
    """Reshares the excess until no target is above its cap."""
    order = sorted(rows, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(rows.values()), set()
    while True:
        left = total - sum(cap * rows[s] for s in capped)
        free = sum(weight[s] for s in rows if s not in capped)
        out = {s: cap * rows[s] if s in capped else left * weight[s] / free for s in rows}
        more = {s for s in rows if s not in capped and out[s] > cap * rows[s]}
        if not more:
            return out
        capped |= more


def docs(spark, counts, extra=""):
    rows = [(i * 100_000 + j, s, " ".join(["w"] * n)) for i, (s, (k, n)) in enumerate(counts.items()) for j in range(k)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string" + extra)


def test_targets_are_water_filled(spark):
    counts = {"b": (4, 10), "a": (1, 3), None: (20, 7), "c": (2, 1), "é": (3, 0), "d": (50, 2)}
    got = {r.source: r.target for r in mixing.mix_report(docs(spark, counts), [5, 2, 1]).join(docs(spark, counts).select("doc_id", "source"), "doc_id").collect()}
    want = targets({s: k * n for s, (k, n) in counts.items()})
    assert got == pytest.approx(want)


def test_takes_come_near_targets_and_reruns_agree(spark):
    counts = {"a": (3000, 4), "b": (2000, 5), "c": (2500, 3), None: (500, 2)}
    df = docs(spark, counts)
    first, again = (sorted((r.doc_id, r.taken) for r in mixing.mix_report(df, [5, 2, 1]).collect()) for _ in range(2))
    assert first == again
    rows = mixing.mix_report(df, [5, 2, 1]).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) < 0.07 * r["max(target)"] for r in rows)
    assert all(r.taken <= 3 * r.size for r in mixing.mix_report(df, [5, 2, 1]).collect())


def test_the_salted_join_agrees(spark, monkeypatch):
    df = docs(spark, {"a": (30, 4), None: (20, 5)})
    want = sorted(map(tuple, mixing.mix_report(df, [5, 2, 1]).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mixing.mix_report(df, [5, 2, 1]).collect())) == want


def test_mix_emits_whole_rows(spark):
    df = docs(spark, {"a": (40, 4), "b": (40, 5)}).withColumnRenamed("doc_id", "mix").selectExpr("mix", "mix AS doc_id", "source", "text")
    taken = {r.doc_id: r.copies for r in mixing.mix_report(df, [5, 2, 1]).collect()}
    out = mixing.mix(df, [5, 2, 1])
    assert out.columns == df.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}


def test_edges(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix_report(spark.createDataFrame([], schema), [5, 2, 1]).collect() == []
    rows = [(None, None, None), (1, "a", ""), (2, "a", " \t"), (3, None, None)]
    got = mixing.mix_report(spark.createDataFrame(rows, schema), [5, 2, 1]).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 4


def test_sql_agrees(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op3_mixing"])
    names = [d[0] for d in want.description]
    assert sorted(want.fetchall()) == sorted(tuple(r[n] for n in names) for r in queries.op3_mixing(spark, sf_dir).collect())
