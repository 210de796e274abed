"""Sources, projections, filters, sessionization, joins and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions import codes
from netloom.operators import flows as O
from netloom.plans import views as V
from netloom.plans.registry import query
from netloom.sinks import writers
from netloom.sources import readers

HOUR = 3_600_000_000


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 places, for comparison."""
    return df.select(*(F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# -- sources, over lines given here --


def as_big(columns: str, sql: str) -> str:
    """sql with the columns as BIGINT."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in columns.split())}) FROM ({sql})"


_FIELDS = ["0"] * 85


def _csv_line(**at: str) -> str:
    f = list(_FIELDS)
    for k, v in at.items():
        f[int(k[1:]) if k != "last" else -1] = v
    return ",".join(f)


CSV_LINES = [
    _csv_line(_1="10.0.0.1", _2="1234", _3="10.0.0.2", _4="80", _5="6", _6="7/3/2017 8:55", _7="1500", _8="3", _10="180", last="BENIGN"),
    _csv_line(_1="10.0.0.1", _2="65536", _3="10.0.0.2", _4="12abc", _5="17", _6="07/03/2017 08:56", _7="0", _8="1", _10="60", last=" Ben ign "),
    _csv_line(_1="10.0.0.9", _2="1", _3="10.0.0.2", _4="2", _5="6", _6="7/3/2017 8:57", _7="5", _8="2", _10="90", last=" BENIGN "),
    _csv_line(_1="10.0.0.300", _2="1", _3="10.0.0.2", _4="2", _5="6", _6="7/3/2017 8:57", _7="5", _8="2", _10="90", last="DoS"),
    _csv_line(_1="10.0.0.1", _2="x1", _3="10.0.0.2", _4="2", _5="6", _6="7/3/2017 8:57", _7="5", _8="2", _10="90", last="DoS"),
    ",".join(["0"] * 84),
]


def _lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")


@query(as_big("line_no src_ip dst_ip packets bytes", """SELECT * FROM (VALUES (0, 167772161, 167772162, 1234, 80, 6, 1499072100000000, 1499072101500000, 3, 180, 0), (1, 167772161, 167772162, 0, 12, 17, 1499072160000000, 1499072160000000, 1, 60, 1),
  (2, 167772169, 167772162, 1, 2, 6, 1499072220000000, 1499072220005000, 2, 90, 0)) AS t(line_no, src_ip, dst_ip, src_port, dst_port, proto, start_us, end_us, packets, bytes, label)"""))
def src3_flow_csv(spark, sf_dir):
    f = readers.parse_flow_lines(_lines(spark, CSV_LINES))
    return f.select("line_no", "src_ip", "dst_ip", "src_port", "dst_port", "proto", F.unix_micros("ts_start").alias("start_us"), F.unix_micros("ts_end").alias("end_us"), "packets", "bytes", "label")


@query("SELECT * FROM (VALUES ('7/3/2017 8:55', 1499072100000), ('07/03/2017 08:55', 1499072100000), ('2017-07-03', NULL)) AS t(text, ms)")
def src4_csv_time(spark, sf_dir):
    df = spark.createDataFrame([("7/3/2017 8:55",), ("07/03/2017 08:55",), ("2017-07-03",)], "text string")
    return df.select("text", F.unix_millis(F.try_to_timestamp("text", F.lit("M/d/yyyy H:mm"))).alias("ms"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS label FROM events")
def src5_label_mapping(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "view", F.concat(F.lit(" BEN"), F.lit("IGN "))).otherwise(F.col("event_type"))
    return e.select("event_id", readers.label_of(text).alias("label"))


PACKET_LINES = ["4 167772161 167772162 1234 80 0 17 60", "4 167772161 167772162 1234 80 9000000 33 52", "4 167772161 167772162 1234 80 19000000 65 52", "6 1 2 5353 5353 20000000 258 100", "x bad line", ""]


@query(as_big("pkt_idx src dst us", """SELECT * FROM (VALUES (0, '4', 167772161, 167772162, NULL, 1234, 80, 0, 17, 60, 4), (1, '4', 167772161, 167772162, NULL, 1234, 80, 9000000, 33, 52, 4), (2, '4', 167772161, 167772162, NULL, 1234, 80, 19000000, 65, 52, 4),
  (3, '6', NULL, NULL, '1', 5353, 5353, 20000000, 258, 100, 8), (4, 'bad', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)) AS t(pkt_idx, kind, src, dst, src6, sport, dport, us, code, len, stack)"""))
def src6_packet_text(spark, sf_dir):
    p = readers.parse_packet_lines(_lines(spark, PACKET_LINES))
    return p.select("pkt_idx", "kind", "src", "dst", "src6", "sport", "dport", F.unix_micros("ts").alias("us"), "code", "len", "stack")


@query(as_big("label_no", "SELECT * FROM (VALUES (0, 0), (1, 0), (2, 1), (3, 0), (4, 1)) AS t(label_no, label)"))
def src7_packet_labels(spark, sf_dir):
    return readers.parse_labels(_lines(spark, ["00 x1", "", "0;1"]))


@query(as_big("src start_us end_us packets bytes", """SELECT * FROM (VALUES (167772161, 0, 9000000, 49, 2, 112, 0), (167772161, 19000000, 19000000, 65, 1, 52, 1)) AS t(src, start_us, end_us, code, packets, bytes, label)"""))
def src11_packet_flows(spark, sf_dir):
    packets = O.ipv4(readers.parse_packet_lines(_lines(spark, PACKET_LINES)))
    flows = O.sessionize(O.with_labels(packets, readers.parse_labels(_lines(spark, ["00100"])).withColumnRenamed("label_no", "pkt_idx")), 10_000_000)
    return flows.select("src", F.unix_micros("ts_start").alias("start_us"), F.unix_micros("ts_end").alias("end_us"), "code", "packets", "bytes", "label")


@query("""SELECT event_id, regexp_replace(regexp_extract(concat('a.b/', event_type, '.', CAST(user_id AS VARCHAR), '.csv'), '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM events""")
def src12_stem(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return e.select("event_id", codes.stem(F.concat(F.lit("a.b/"), "event_type", F.lit("."), F.col("user_id").cast("string"), F.lit(".csv"))).alias("stem"))


@query(f"""WITH {V.PACKETS} SELECT pkt_idx, concat_ws(' ', kind, CAST(src AS VARCHAR), CAST(dst AS VARCHAR), CAST(sport AS VARCHAR), CAST(dport AS VARCHAR), CAST(us - 1000 AS VARCHAR), CAST(code AS VARCHAR), CAST(len AS VARCHAR)) AS value FROM packets WHERE kind = '4'""")
def snk13_packet_text(spark, sf_dir):
    p = V.packets(spark, sf_dir).where("kind = '4'")
    none = F.lit(None).cast("string")
    return readers.packet_text(p.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("src6", none).withColumn("dst6", none), -1000)


# -- projections and filters --


@query(f"WITH {V.PACKETS} SELECT pkt_idx, stack FROM packets")
def prj1_stack_code(spark, sf_dir):
    return V.packets(spark, sf_dir).select("pkt_idx", codes.stack_code(F.col("code")).alias("stack"))


@query(f"WITH {V.PACKETS} SELECT pkt_idx, CASE stack WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 8 THEN 3 ELSE 4 END AS kind, CASE stack WHEN 1 THEN 'ICMP' WHEN 2 THEN 'IGMP' WHEN 4 THEN 'TCP' WHEN 8 THEN 'UDP' ELSE 'UNKNOWN' END AS name FROM packets")
def prj2_stack_type(spark, sf_dir):
    kind = codes.stack_type(F.col("stack"))
    return V.packets(spark, sf_dir).select("pkt_idx", kind.alias("kind"), codes.type_name(kind).alias("name"))


@query(f"WITH {V.PACKETS} SELECT DISTINCT dst AS src, src AS dst, dport AS sport, sport AS dport, stack FROM packets")
def prj3_reverse_tuple(spark, sf_dir):
    return O.reversed_key(V.packets(spark, sf_dir).select(*O.KEY).distinct())


@query(f"WITH {V.FLOWS} SELECT k_order, k_line, k_part, dur_ms FROM flows")
def prj4_duration(spark, sf_dir):
    return V.flows(spark, sf_dir).select("k_order", "k_line", "k_part", O.duration_ms(F.col("ts_start"), F.col("ts_end")).alias("dur_ms"))


@query(f"WITH {V.FLOWS} SELECT k_order, k_line, k_part, round(epoch_us(ts_end) / 1e6 - epoch_us(ts_start) / 1e6, 6) AS fct FROM flows")
def prj5_completion_time(spark, sf_dir):
    return r6(V.flows(spark, sf_dir).select("k_order", "k_line", "k_part", O.completion_seconds(F.col("ts_start"), F.col("ts_end")).alias("fct")))


@query(f"""WITH {V.FLOWS} SELECT k_order, k_line, k_part, CAST(src_port AS DOUBLE) AS f_sport, CAST(dst_port AS DOUBLE) AS f_dport, CAST(proto AS DOUBLE) AS f_proto, CAST(dur_ms AS DOUBLE) AS f_duration,
  CAST(packets AS DOUBLE) AS f_packets, round(CASE WHEN packets > 0 THEN CAST(bytes AS DOUBLE) / packets ELSE 0 END, 6) AS f_bytes_per_packet FROM flows""")
def prj6_flow_vector(spark, sf_dir):
    return r6(O.flow_vector(V.flows(spark, sf_dir), ["k_order", "k_line", "k_part"]))


@query(f"WITH {V.PACKETS} SELECT kind, count(*) AS n FROM packets WHERE kind <> 'bad' GROUP BY kind")
def flt1_without_bad(spark, sf_dir):
    return O.without_bad(V.packets(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {V.PACKETS} SELECT pkt_idx FROM packets WHERE kind = '4'")
def flt2_ipv4(spark, sf_dir):
    return O.ipv4(V.packets(spark, sf_dir)).select("pkt_idx")


@query(f"WITH {V.FLOWS} SELECT src_ip, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM flows WHERE label = 0 GROUP BY src_ip")
def flt3_benign(spark, sf_dir):
    return V.flows(spark, sf_dir).where("label = 0").groupBy("src_ip").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query(f"WITH {V.FLOWS} SELECT src_ip, dst_ip, k_order, k_line, packets FROM flows ORDER BY {V.SQL_ORDER} LIMIT 500")
def flt4_first_rows(spark, sf_dir):
    return O.first_rows(V.flows(spark, sf_dir), V.ORDER, 500).select("src_ip", "dst_ip", "k_order", "k_line", "packets")


@query(f"""WITH {V.FLOWS}, o AS (SELECT *, row_number() OVER (ORDER BY {V.SQL_ORDER}) AS flow_idx, count(*) OVER () AS n FROM flows)
SELECT flow_idx, k_order, k_line, k_part, flow_idx <= floor(0.8 * n) AS is_train FROM o""")
def flt5_prefix_split(spark, sf_dir):
    return O.prefix_split(V.flows(spark, sf_dir), V.ORDER, 0.8).select("flow_idx", "k_order", "k_line", "k_part", "is_train")


@query(f"WITH {V.FLOWS} SELECT CASE WHEN packets > 15 THEN 'long' ELSE 'short' END AS kind, count(*) AS flows, CAST(sum(packets) AS BIGINT) AS packets FROM flows GROUP BY 1")
def flt6_length_classes(spark, sf_dir):
    return O.length_classes(V.flows(spark, sf_dir))


@query(f"WITH {V.FLOWS} SELECT k_order, k_line, k_part, CAST(bytes > 50000 AS INTEGER) AS pred FROM flows")
def flt7_threshold(spark, sf_dir):
    return V.flows(spark, sf_dir).select("k_order", "k_line", "k_part", (F.col("bytes") > 50000).cast("int").alias("pred"))


@query(f"WITH {V.FLOWS}, b AS (SELECT DISTINCT src_ip FROM flows WHERE bytes > 90000) SELECT k_order, k_line, k_part, CAST(src_ip IN (SELECT src_ip FROM b) AS INTEGER) AS member FROM flows")
def flt8_membership(spark, sf_dir):
    f = V.flows(spark, sf_dir)
    big = f.where("bytes > 90000").select("src_ip").distinct().withColumn("member", F.lit(1))
    return f.join(big, "src_ip", "left").select("k_order", "k_line", "k_part", F.coalesce("member", F.lit(0)).alias("member"))


# -- sessionization --


def _sessions_sql(key: str, timeout: int, more: str = "") -> str:
    return f"""WITH {V.PACKETS}, g AS (SELECT *, us - lag(us) OVER (PARTITION BY {key} ORDER BY ts, pkt_idx) AS gap FROM packets{more}),
s AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap >= {timeout} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY ts, pkt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS sid FROM g),
f AS (SELECT {key}, sid, min(us) AS start_us, max(us) AS end_us, bit_or(code) AS code, count(*) AS packets, CAST(sum(len) AS BIGINT) AS bytes, max(label) AS label FROM s GROUP BY {key}, sid)"""


def _flow_rows(flows: DataFrame, key: list[str]) -> DataFrame:
    return flows.select(*key, "sid", codes.micros(F.col("ts_start")).alias("start_us"), codes.micros(F.col("ts_end")).alias("end_us"), "code", "packets", "bytes", "label")


@query(_sessions_sql("src", 6 * HOUR) + " SELECT * FROM f")
def ses3_sessionize(spark, sf_dir):
    return _flow_rows(O.sessionize(V.packets(spark, sf_dir), 6 * HOUR, ["src"]), ["src"])


@query(_sessions_sql(", ".join(O.KEY), 72 * HOUR, " WHERE kind = '4'") + " SELECT * FROM f")
def ses4_flow_aggregate(spark, sf_dir):
    return _flow_rows(O.sessionize(O.ipv4(V.packets(spark, sf_dir)), 72 * HOUR), O.KEY)


def _both_versions(spark, sf_dir) -> DataFrame:
    p = V.packets(spark, sf_dir)
    return O.all_flows(*(O.sessionize(p.where(F.col("kind") == k), 72 * HOUR) for k in ("4", "6")))


_BOTH = _sessions_sql("kind, " + ", ".join(O.KEY), 72 * HOUR, " WHERE kind <> 'bad'")


@query(_BOTH + " SELECT CAST(kind AS INTEGER) AS ipver, CASE stack WHEN 1 THEN 'ICMP' WHEN 2 THEN 'IGMP' WHEN 4 THEN 'TCP' ELSE 'UDP' END AS proto_name, count(*) AS flows FROM f WHERE stack <> 16 GROUP BY 1, 2")
def ses6_protocol_counts(spark, sf_dir):
    return O.protocol_counts(_both_versions(spark, sf_dir))


@query(_sessions_sql("src", 6 * HOUR) + """, h AS (SELECT 'fct' AS hist, CAST(ceil(end_us / 1e6 - start_us / 1e6) AS BIGINT) AS bin FROM f UNION ALL SELECT 'packets', CAST(ceil(log2(packets)) AS BIGINT) FROM f
  UNION ALL SELECT 'bytes', CAST(ceil(log2(greatest(bytes, 1))) AS BIGINT) FROM f) SELECT hist, bin, count(*) AS flows FROM h GROUP BY hist, bin""")
def ses7_histograms(spark, sf_dir):
    return O.histograms(O.sessionize(V.packets(spark, sf_dir), 6 * HOUR, ["src"]))


@query(_BOTH + " SELECT (SELECT count(*) FROM packets WHERE kind <> 'bad') AS packets, CAST(sum(packets) AS BIGINT) AS in_flows, sum(packets) = (SELECT count(*) FROM packets WHERE kind <> 'bad') AS conserved FROM f")
def ses8_conserved(spark, sf_dir):
    return O.conserved(O.without_bad(V.packets(spark, sf_dir)), _both_versions(spark, sf_dir))


@query(f"""WITH {V.PACKETS}, k AS (SELECT DISTINCT src * 16777216 + 65793 AS s, dst AS d, sport, dport, stack FROM packets) SELECT concat_ws(' ', concat_ws('.', s // 16777216, s // 65536 % 256, s // 256 % 256, s % 256), concat_ws('.', d // 16777216, d // 65536 % 256, d // 256 % 256, d % 256),
  sport, dport, CASE stack WHEN 1 THEN 'ICMP' WHEN 2 THEN 'IGMP' WHEN 4 THEN 'TCP' WHEN 8 THEN 'UDP' ELSE 'UNKNOWN' END) AS flow_id FROM k""")
def ses9_flow_id(spark, sf_dir):
    k = V.packets(spark, sf_dir).select((F.col("src") * 16777216 + 65793).alias("s"), F.col("dst").alias("d"), "sport", "dport", "stack").distinct()
    return k.select(O.flow_id(F.col("s"), F.col("d"), F.col("sport"), F.col("dport"), codes.stack_type(F.col("stack"))).alias("flow_id"))


@query(f"WITH {V.PACKETS}, d AS (SELECT DISTINCT src * 16777216 + 65793 AS s FROM packets) SELECT s AS number, s AS again FROM d")
def fn_ip_round_trip(spark, sf_dir):
    d = V.packets(spark, sf_dir).select((F.col("src") * 16777216 + 65793).alias("number")).distinct()
    return d.select("number", codes.ip_number(codes.dotted(F.col("number")), wide=True).alias("again"))


@query(f"""WITH {V.PACKETS}, g AS (SELECT pkt_idx, us - lag(us) OVER (PARTITION BY src, stack ORDER BY ts, pkt_idx) AS gap_us FROM packets) SELECT pkt_idx, gap_us FROM g""")
def win1_gaps(spark, sf_dir):
    w = Window.partitionBy("src", "stack").orderBy("ts", "pkt_idx")
    us = codes.micros(F.col("ts"))
    return V.packets(spark, sf_dir).select("pkt_idx", (us - F.lag(us).over(w)).alias("gap_us"))


def ses1_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = O.ipv4(V.packets(spark, sf_dir))
    return O.replay(p, timeout_s=6 * 3600, evict_s=3 * 3600, key=["src"]).select("src", "sid", codes.micros(F.col("ts_start")).alias("start_us"), codes.micros(F.col("ts_end")).alias("end_us"), "packets", "bytes", "label")


query()(ses1_replay)


_KIND = "CASE stack WHEN 1 THEN 'ICMP' WHEN 2 THEN 'IGMP' WHEN 4 THEN 'TCP' WHEN 8 THEN 'UDP' ELSE 'UNKNOWN' END"
_DOTTED = "concat_ws('.', {0} // 16777216, {0} // 65536 % 256, {0} // 256 % 256, {0} % 256)"
_KEYED = _sessions_sql(", ".join(O.KEY), 72 * HOUR, " WHERE kind = '4'")


@query(f"""{_KEYED} SELECT concat_ws(' ', {_DOTTED.format('src')}, {_DOTTED.format('dst')}, sport, dport, {_KIND}, printf('%.6f', start_us / 1e6), printf('%.6f', end_us / 1e6), printf('%.6f', end_us / 1e6 - start_us / 1e6),
  CAST(packets AS VARCHAR), CAST(bytes AS VARCHAR), CAST(label AS VARCHAR)) AS value FROM f""")
def snk11_flow_lines(spark, sf_dir):
    return writers.flow_lines(O.sessionize(O.ipv4(V.packets(spark, sf_dir)), 72 * HOUR), labels=True)


@query(f"""{_KEYED}, t AS (SELECT {', '.join(O.KEY)}, sid, string_agg(concat(pkt_idx, ':', label), ' ' ORDER BY pkt_idx) AS value FROM s GROUP BY {', '.join(O.KEY)}, sid) SELECT value FROM t""")
def snk12_lineage(spark, sf_dir):
    p = O.ipv4(V.packets(spark, sf_dir))
    lines = writers.lineage_lines(O.sessionize(p, 72 * HOUR, lineage=True), p.select("pkt_idx", "label"))
    return lines.select("value")


# -- joins, sorts, sets --


@query(f"WITH {V.PACKETS}, l AS (SELECT pkt_idx, label FROM packets WHERE pkt_idx % 3 <> 0) SELECT p.pkt_idx, coalesce(l.label, 0) AS label FROM packets p LEFT JOIN l ON p.pkt_idx = l.pkt_idx")
def joi1_packet_labels(spark, sf_dir):
    p = V.packets(spark, sf_dir)
    return O.with_labels(p.drop("label"), p.where("pkt_idx % 3 <> 0").select("pkt_idx", "label")).select("pkt_idx", "label")


@query(f"WITH {V.PACKETS} SELECT kind, stack, count(*) AS n FROM packets WHERE kind = '4' GROUP BY kind, stack UNION ALL SELECT kind, stack, count(*) FROM packets WHERE kind = '6' GROUP BY kind, stack")
def set1_union_all(spark, sf_dir):
    p = V.packets(spark, sf_dir)
    return p.where("kind = '4'").unionByName(p.where("kind = '6'")).groupBy("kind", "stack").agg(F.count("*").alias("n"))


@query(f"WITH {V.FLOWS} SELECT src_ip AS node FROM flows WHERE bytes > 80000 UNION SELECT dst_ip FROM flows WHERE packets > 48")
def set2_union(spark, sf_dir):
    f = V.flows(spark, sf_dir)
    return f.where("bytes > 80000").select(F.col("src_ip").alias("node")).union(f.where("packets > 48").select("dst_ip")).distinct()


@query(f"WITH {V.FLOWS}, o AS (SELECT *, row_number() OVER (ORDER BY {V.SQL_ORDER}) AS flow_idx FROM flows) SELECT flow_idx, k_order, k_line, k_part FROM o")
def srt1_flow_order(spark, sf_dir):
    from netloom.operators import ordering

    return ordering.indexed(V.flows(spark, sf_dir), V.ORDER, "flow_idx").select("flow_idx", "k_order", "k_line", "k_part")
