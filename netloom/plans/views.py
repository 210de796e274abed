"""Packet, flow and vector views over the test tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import codes
from netloom.functions.store import table

#: Codes of the event types: TCP SYN, UDP, ICMP, IGMP and unknown, each over IPv4.
EVENT_CODES = {"view": 17, "click": 257, "purchase": 5, "signup": 9, "error": 513}

#: A unique order of the flow view.
ORDER = ["ts_start", "k_order", "k_line", "k_part", "k_supp", "k_ship"]


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    code = F.lit(None).cast("int")
    for name, value in EVENT_CODES.items():
        code = F.when(F.col("event_type") == name, F.lit(value)).otherwise(code)
    kind = F.when(F.col("event_id") % 97 == 0, "bad").when(F.col("event_id") % 13 == 0, "6").otherwise("4")
    return e.select(
        F.col("event_id").alias("pkt_idx"), kind.alias("kind"), F.col("user_id").alias("src"), ((F.col("user_id") * 7) % 50).alias("dst"), (F.col("user_id") % 100 + 1000).cast("int").alias("sport"),
        F.lit(80).alias("dport"), "ts", code.alias("code"), codes.stack_code(code).alias("stack"), F.floor("value").cast("long").alias("len"), (F.col("event_type") == "error").cast("int").alias("label"),
    )


PACKETS = """packets AS (
  SELECT event_id AS pkt_idx, CASE WHEN event_id % 97 = 0 THEN 'bad' WHEN event_id % 13 = 0 THEN '6' ELSE '4' END AS kind,
    user_id AS src, (user_id * 7) % 50 AS dst, CAST(user_id % 100 + 1000 AS INTEGER) AS sport, 80 AS dport, ts, epoch_us(ts) AS us,
    CASE event_type WHEN 'view' THEN 17 WHEN 'click' THEN 257 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 9 WHEN 'error' THEN 513 END AS code,
    CASE event_type WHEN 'view' THEN 4 WHEN 'click' THEN 8 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 16 END AS stack,
    CAST(floor(value) AS BIGINT) AS len, CAST(event_type = 'error' AS INTEGER) AS label
  FROM events)"""


def flows(spark: SparkSession, sf_dir: str, fold: int | None = None) -> DataFrame:
    """Flow records; fold maps addresses to that many nodes, which makes self-loops."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    ip = lambda c: (F.col(c) % fold if fold else F.col(c)).alias
    return j.select(
        ip("o_custkey")("src_ip"), ip("l_suppkey")("dst_ip"), (F.col("l_partkey") % 65536).cast("int").alias("src_port"), F.col("l_linenumber").cast("int").alias("dst_port"),
        (F.col("l_linenumber") % 5).cast("int").alias("proto"), F.col("o_orderdate").alias("ts_start"), F.greatest("o_orderdate", "l_shipdate").alias("ts_end"),
        F.floor("l_quantity").cast("long").alias("packets"), F.floor("l_extendedprice").cast("long").alias("bytes"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_orderkey").alias("k_order"), F.col("l_linenumber").alias("k_line"), F.col("l_partkey").alias("k_part"), F.col("l_suppkey").alias("k_supp"), F.col("l_shipdate").alias("k_ship"),
    )


def flows_sql(fold: int | None = None) -> str:
    ip = f" % {fold}" if fold else ""
    return f"""flows AS (
  SELECT o_custkey{ip} AS src_ip, l_suppkey{ip} AS dst_ip, l_partkey % 65536 AS src_port, l_linenumber AS dst_port, l_linenumber % 5 AS proto,
    o_orderdate AS ts_start, greatest(o_orderdate, l_shipdate) AS ts_end, CAST(floor(l_quantity) AS BIGINT) AS packets, CAST(floor(l_extendedprice) AS BIGINT) AS bytes,
    CAST(l_returnflag = 'R' AS INTEGER) AS label, epoch_us(greatest(o_orderdate, l_shipdate)) // 1000 - epoch_us(o_orderdate) // 1000 AS dur_ms,
    l_orderkey AS k_order, l_linenumber AS k_line, l_partkey AS k_part, l_suppkey AS k_supp, l_shipdate AS k_ship
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


FLOWS = flows_sql()
SQL_ORDER = ", ".join(ORDER)


#: Components of an embedding.
DIMENSIONS = 64


def vectors(spark: SparkSession, sf_dir: str, d: int = DIMENSIONS) -> DataFrame:
    """The first d components of the embeddings, all by default, as columns x0, x1, ..."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *(F.element_at("embedding", i + 1).cast("double").alias(f"x{i}") for i in range(d)))


def vectors_sql(d: int = 8) -> str:
    return "vectors AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(d)) + " FROM embeddings)"


def state_sql(fold: int | None = None) -> str:
    """CTEs up to ``state``: the flows in order with the graph's sizes after each."""
    return f"""{flows_sql(fold)},
base AS (SELECT *, row_number() OVER (ORDER BY {SQL_ORDER}) AS ord FROM flows),
edges AS (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY ord) AS edge_count FROM base),
ends AS (
  SELECT ord, 's' AS role, src_ip AS node, CAST(edge_count = 1 AS INTEGER) AS o, 0 AS i, 1 AS seen FROM edges
  UNION ALL SELECT ord, 't', dst_ip, 0, CAST(edge_count = 1 AS INTEGER), CAST(src_ip <> dst_ip AS INTEGER) FROM edges),
sums AS (SELECT ord, role, seen, sum(o) OVER w AS n_out, sum(i) OVER w AS n_in, sum(seen) OVER w AS times FROM ends
  WINDOW w AS (PARTITION BY node ORDER BY ord RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
by_flow AS (SELECT ord, max(n_out) FILTER (role = 's') AS src_out, max(n_in) FILTER (role = 's') AS src_in, max(n_in) FILTER (role = 't') AS dst_in,
    max(n_out) FILTER (role = 't') AS dst_out, count(*) FILTER (times = 1 AND (role = 's' OR seen = 1)) AS new_nodes FROM sums GROUP BY ord),
state AS (SELECT edges.*, CAST(src_out AS BIGINT) AS src_out, CAST(src_in AS BIGINT) AS src_in, CAST(dst_in AS BIGINT) AS dst_in, CAST(dst_out AS BIGINT) AS dst_out,
    CAST(sum(new_nodes) OVER (ORDER BY edges.ord) AS BIGINT) AS active_nodes, CAST(sum(CAST(edge_count = 1 AS INTEGER)) OVER (ORDER BY edges.ord) AS BIGINT) AS active_edges
  FROM edges JOIN by_flow ON edges.ord = by_flow.ord)"""


#: Further CTEs: the 20 features of each flow of ``state``.
FEATURES_SQL = """density AS (SELECT *, CAST(greatest(dur_ms, 1) AS DOUBLE) AS dur, CASE WHEN active_nodes > 0 THEN CAST(active_edges AS DOUBLE) / active_nodes ELSE 0 END AS v16, ln(1 + edge_count) AS v6 FROM state),
features AS (SELECT ord, src_ip, dst_ip, label, ln(1 + src_out) AS v0, ln(1 + src_in) AS v1, ln(1 + dst_in) AS v2, ln(1 + dst_out) AS v3, CAST(abs(src_out - src_in) AS DOUBLE) AS v4,
    CAST(abs(dst_out - dst_in) AS DOUBLE) AS v5, v6, ln(1 + bytes) AS v7, ln(1 + packets) AS v8, ln(1 + dur) AS v9, ln(1 + bytes / dur) AS v10, ln(1 + packets / dur) AS v11,
    CASE WHEN packets > 0 THEN CAST(bytes AS DOUBLE) / packets ELSE 0 END AS v12, CAST(proto AS DOUBLE) AS v13, ln(1 + active_nodes) AS v14, ln(1 + active_edges) AS v15, v16,
    CASE WHEN src_out > 0 THEN ln(1 + src_out) * (1 - CAST(src_in AS DOUBLE) / (src_out + src_in + 1)) ELSE 0 END AS v17, CASE WHEN src_out > 10 THEN 1.0 ELSE 0.0 END AS v18,
    1 / (v16 + 1) * (1 / (v6 + 1)) AS v19 FROM density)"""
