"""Learners, detectors and streams.  Those without SQL are checked by rows and by tests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.config import DbstreamConfig, EngineConfig, IForestConfig, KMeansConfig
from netloom.functions import codes
from netloom.functions.store import shared_dir
from netloom.operators import detectors, flows, graph, learners, ordering, scaling
from netloom.plans import views as V
from netloom.plans.flow_queries import HOUR, _sessions_sql, r6
from netloom.plans.graph_queries import STATS_SQL
from netloom.plans.registry import query
from netloom.streaming import pipelines

TTL_MS = 10 * 86_400_000
#: DBSCAN's radius over scaled components and its least number of points.
EPSILON, LEAST = 0.25, 5
XS = [f"x{i}" for i in range(V.DIMENSIONS)]


def _vectors(spark, sf_dir) -> DataFrame:
    v = V.vectors(spark, sf_dir)
    return scaling.fit_scaler(v, XS).transform(v)


def _split(spark, sf_dir) -> DataFrame:
    """Flow records with flow_idx and is_train; stored once, where they are put in order."""
    f = V.flows(spark, sf_dir)
    return flows.prefix_split(f, V.ORDER, keep=[c for c in f.columns if not c.startswith("k_")]).drop(ordering.BUCKET)


@query()
def ml2_pca(spark, sf_dir):
    return scaling.pca_2d(V.vectors(spark, sf_dir), XS, ["vec_id"])


@query()
def det3_iforest(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return learners.fit_iforest(v, XS, IForestConfig(), "vec_id").score(v).select("vec_id", "score")


@query()
def det5_kmeans(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return learners.fit_kmeans(v, XS, KMeansConfig(), "vec_id").assign(v).select("vec_id", "cluster", "distance")


def _scaled_sql() -> str:
    """CTEs up to v (vec_id, x): the embeddings with each component scaled to [0, 1]."""
    return """e AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS y FROM embeddings, range(1, 65) r(i)),
z AS (SELECT vec_id, i, (y - min(y) OVER w) / CASE WHEN max(y) OVER w = min(y) OVER w THEN 1 ELSE max(y) OVER w - min(y) OVER w END AS z FROM e WINDOW w AS (PARTITION BY i)),
v AS (SELECT vec_id, list(z ORDER BY i) AS x FROM z GROUP BY vec_id)"""


@query(f"""WITH RECURSIVE {_scaled_sql()}, near AS (SELECT a.vec_id AS p, b.vec_id AS q FROM v a, v b WHERE list_distance(a.x, b.x) <= {EPSILON}),
core AS (SELECT p FROM near GROUP BY p HAVING count(*) >= {LEAST}),
reach(p, q) AS (SELECT p, p FROM core UNION SELECT reach.p, near.q FROM reach JOIN near ON near.p = reach.q JOIN core ON core.p = near.q),
named AS (SELECT p, min(q) AS cluster FROM reach GROUP BY p), placed AS (SELECT near.p, min(named.cluster) AS cluster FROM near JOIN named ON near.q = named.p GROUP BY near.p),
c AS (SELECT v.vec_id AS idx, coalesce(named.cluster, placed.cluster) AS cluster, x FROM v LEFT JOIN named ON v.vec_id = named.p LEFT JOIN placed ON v.vec_id = placed.p),
m AS (SELECT cluster, i, avg(x[i]) AS m FROM c, range(1, 65) r(i) WHERE cluster IS NOT NULL GROUP BY cluster, i), centre AS (SELECT cluster, list(m ORDER BY i) AS m FROM m GROUP BY cluster),
d AS (SELECT idx, c.cluster, round(coalesce(list_distance(x, m), -1), 6) AS distance FROM c LEFT JOIN centre ON c.cluster = centre.cluster),
far AS (SELECT idx FROM (SELECT idx, row_number() OVER (PARTITION BY cluster ORDER BY distance DESC, idx) AS k FROM d WHERE cluster IS NOT NULL) WHERE k = 1),
loose AS (SELECT cluster FROM d WHERE cluster IS NOT NULL GROUP BY cluster ORDER BY avg(distance) DESC, cluster LIMIT 1)
SELECT idx, cluster, distance, CAST(idx IN (SELECT idx FROM far) OR coalesce(cluster IN (SELECT cluster FROM loose), false) AS INTEGER) AS pred FROM d""")
def det7_dbscan(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("idx", F.col("vec_id"))
    placed = learners.dbscan(v, XS, EPSILON, LEAST)
    distances = detectors.centroid_distances(placed, XS).withColumn("distance", F.round("distance", 6))
    return detectors.cluster_outliers(distances).select("idx", "cluster", "distance", "pred")


@query()
def det8_dbstream(spark, sf_dir):
    v = _vectors(spark, sf_dir).select(F.pmod("vec_id", F.lit(8)).alias("pid"), F.col("vec_id").alias("flow_idx"), F.col("vec_id").cast("double").alias("t"), *XS)
    return learners.dbstream_partitions(v, XS, DbstreamConfig(epsilon=0.4, lambda_=0.0001, mu=5, beta_noise=0.15, max_clusters=1000, eta=0.15, connection=0.005))


@query()
def det13_greedy_partitions(spark, sf_dir):
    return learners.greedy_partitions(_split(spark, sf_dir)).select("flow_idx", "pid")


@query(f"WITH {V.FLOWS} SELECT k_order, k_line, k_part, CAST(CAST('0x' || substr(md5(CAST(src_ip AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS BIGINT) AS pid FROM flows")
def det13_hashed_partitions(spark, sf_dir):
    return learners.hashed_partitions(V.flows(spark, sf_dir)).select("k_order", "k_line", "k_part", "pid")


def _detector(name: str):
    def run(spark, sf_dir):
        out = detectors.detect(_split(spark, sf_dir), EngineConfig(algorithm=name))
        return r6(out.tables["stats"]) if out.predictions is None else out.predictions.select("flow_idx", "label", "pred")

    return run


for _query, _name in (("det1_analyze", "Analyze"), ("det2_random_forest", "RF"), ("det4_isolation_forest", "IForest"), ("det6_mini_batch_kmeans", "Mini_Batch_KMeans"), ("det15_mix", "Mix")):
    _run = _detector(_name)
    _run.__name__ = _query
    query(STATS_SQL if _name == "Analyze" else None)(_run)


def _streamed(spark, df: DataFrame, build, mode: str = "append") -> DataFrame:
    """Writes df as files, runs build over them as a stream to its end, and returns what came out."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    df.write.parquet(f"{at}/in")
    live = build(spark.readStream.schema(df.schema).parquet(f"{at}/in"))
    live.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(live.schema).parquet(f"{at}/out")


def _with_end(packets: DataFrame, gap_us: int) -> DataFrame:
    """Packets and one far later, which moves the watermark past all sessions."""
    last = packets.agg(F.max("ts").alias("ts")).select(F.timestamp_micros(F.unix_micros("ts") + 10 * gap_us).alias("ts"))
    end = last.select(*(F.col(c) if c == "ts" else F.lit(-1).cast(t).alias(c) for c, t in packets.dtypes))
    return packets.unionByName(end)


@query(_sessions_sql("src", 6 * HOUR) + " SELECT src, start_us, end_us, code, packets, bytes, label FROM f")
def str1_session_stream(spark, sf_dir):
    p = V.packets(spark, sf_dir).select("src", F.col("ts").cast("timestamp").alias("ts"), "code", "len", "label")
    out = _streamed(spark, _with_end(p, 6 * HOUR).coalesce(1), lambda s: pipelines.session_flows(s, ["src"], 6 * HOUR, "1 second"))
    return out.where("src >= 0").select("src", codes.micros(F.col("ts_start")).alias("start_us"), codes.micros(F.col("ts_end")).alias("end_us"), "code", "packets", "bytes", "label")


@query(f"""WITH {V.FLOWS}, o AS (SELECT src_ip, dst_ip, epoch_us(ts_start) // 1000 AS t, greatest(epoch_us(ts_end), epoch_us(ts_start)) // 1000 AS e FROM flows),
n AS (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY t, e) AS k FROM o), c AS (SELECT *, CAST(coalesce(t > max(e) OVER w + {TTL_MS}, true) AS INTEGER) AS anew FROM n WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, sum(anew) OVER (PARTITION BY src_ip, dst_ip ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS life FROM c)
SELECT src_ip, dst_ip, t, row_number() OVER (PARTITION BY src_ip, dst_ip, life ORDER BY k) AS edge_count FROM l""")
def str3_edge_stream(spark, sf_dir):
    f = V.flows(spark, sf_dir).select("src_ip", "dst_ip", F.col("ts_start").cast("timestamp").alias("ts_start"), F.col("ts_end").cast("timestamp").alias("ts_end"))
    return _streamed(spark, f.coalesce(1), lambda s: pipelines.edge_counts(s, TTL_MS, "1 day"))


@query()
def str5_cluster_stream(spark, sf_dir):
    v = _vectors(spark, sf_dir).select(F.pmod("vec_id", F.lit(8)).alias("pid"), F.col("vec_id").alias("idx"), F.timestamp_seconds("vec_id").alias("ts"), *XS)
    cfg = DbstreamConfig(epsilon=0.4, lambda_=0.0001, mu=5, beta_noise=0.15, max_clusters=1000, eta=0.15, connection=0.005)
    return _streamed(spark, v.coalesce(1), lambda s: pipelines.stream_clusters(s, XS, cfg, "1 hour"))


@query()
def str7_scored_stream(spark, sf_dir):
    """An isolation forest fitted on benign vectors scores a stream in micro-batches."""
    v = _vectors(spark, sf_dir)
    forest = learners.fit_iforest(v, XS, IForestConfig(), "vec_id")
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    v.write.parquet(f"{at}/in")
    live = spark.readStream.schema(v.schema).parquet(f"{at}/in")
    pipelines.scored(live, lambda b: forest.score(b).select("vec_id", "score"), lambda b, n: b.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("vec_id", "score")
