"""Graph state, features, aggregates, signatures, divergences and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.store import stored
from netloom.operators import divergence, flows, graph, learners, ordering, profile, scaling
from netloom.plans import views as V
from netloom.plans.flow_queries import r6
from netloom.plans.registry import query

FEATURES = ", ".join(f"round({v}, 6) AS {v}" for v in graph.FEATURES)
BASE = f"WITH {V.state_sql()},\n{V.FEATURES_SQL}"
EPS = "1e-12"


def featured(spark, sf_dir, fold: int | None = None) -> DataFrame:
    f = V.flows(spark, sf_dir, fold)
    return graph.features(graph.cumulative_state(f, V.ORDER, graph.READ), ["ord", "src_ip", "dst_ip", "label"])


@query(f"WITH {V.state_sql()} SELECT ord, edge_count, src_out, src_in, dst_in, dst_out, active_nodes, active_edges FROM state")
def grf1_graph_state(spark, sf_dir):
    return graph.cumulative_state(V.flows(spark, sf_dir), V.ORDER, graph.ENDS).select("ord", *graph.STATE)


@query(f"{BASE} SELECT ord, src_ip, dst_ip, label, {FEATURES} FROM features")
def grf7_graph_features(spark, sf_dir):
    return r6(featured(spark, sf_dir))


TTL_DAYS = 10
_TTL = TTL_DAYS * 86_400_000


#: CTEs: flows in order (o), their place in their edge's life (e), the edges' lives.
_LIVES = f"""{V.FLOWS},
o AS (SELECT *, row_number() OVER (ORDER BY {V.SQL_ORDER}) AS ord, epoch_us(ts_start) // 1000 AS t, greatest(epoch_us(ts_end), epoch_us(ts_start)) // 1000 + {_TTL} AS until FROM flows),
c AS (SELECT *, CAST(t > max(until) OVER w AS INTEGER) AS dead FROM o WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, sum(coalesce(dead, 1)) OVER (PARTITION BY src_ip, dst_ip ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS life FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip, life ORDER BY ord) AS edge_count FROM l),
lives AS (SELECT src_ip, dst_ip, life, min(t) AS t, min(ord) AS ord, max(until) AS until FROM l GROUP BY ALL)"""


def _alive(table: str, name: str) -> str:
    """CTEs up to ``name`` (ord, n): the rows of ``table`` (ord, until) that are born and not past at each flow."""
    return f"""{name}_b AS (SELECT e.ord, e.t, count(*) FILTER (x.ord IS NOT NULL) OVER (ORDER BY e.ord RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM e LEFT JOIN {table} x ON e.ord = x.ord),
{name}_d AS (SELECT until, sum(count(*)) OVER (ORDER BY until) AS n FROM {table} GROUP BY until),
{name} AS (SELECT DISTINCT b.ord, CAST(b.n - coalesce(d.n, 0) AS BIGINT) AS n FROM {name}_b b ASOF LEFT JOIN {name}_d d ON b.t > d.until)"""


@query(f"WITH {_LIVES}, {_alive('lives', 'edges_n')} SELECT e.ord, e.edge_count, edges_n.n AS active_edges FROM e JOIN edges_n ON e.ord = edges_n.ord")
def grf3_ttl_edges(spark, sf_dir):
    return graph.ttl_state(V.flows(spark, sf_dir), V.ORDER, _TTL).select("ord", "edge_count", "active_edges")


def _degree(mine: str, end: str) -> str:
    """CTE: how many live edges have ``mine`` at their ``end``, at each flow."""
    return f"{mine}_{end} AS (SELECT e.ord, count(*) AS n FROM e JOIN lives l ON l.{end} = e.{mine} AND l.ord <= e.ord AND l.until >= e.t GROUP BY e.ord)"


_DEGREES = {"src_out": ("src_ip", "src_ip"), "src_in": ("src_ip", "dst_ip"), "dst_in": ("dst_ip", "dst_ip"), "dst_out": ("dst_ip", "src_ip")}
_NODES = """incident AS (SELECT src_ip AS node, t, ord, until FROM lives UNION ALL SELECT dst_ip, t, ord, until FROM lives WHERE src_ip <> dst_ip),
gaps AS (SELECT *, CAST(coalesce(t > max(until) OVER w, true) AS INTEGER) AS anew FROM incident WINDOW w AS (PARTITION BY node ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
spans AS (SELECT *, sum(anew) OVER (PARTITION BY node ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span FROM gaps),
nodes AS (SELECT node, span, min(ord) AS ord, max(until) AS until FROM spans GROUP BY ALL)"""


@query(f"""WITH {_LIVES}, {_alive('lives', 'edges_n')}, {_NODES}, {_alive('nodes', 'nodes_n')}, {', '.join(_degree(*x) for x in _DEGREES.values())}
SELECT e.ord, {', '.join(f'CAST(coalesce({m}_{x}.n, 0) AS BIGINT) AS {name}' for name, (m, x) in _DEGREES.items())}, e.edge_count, nodes_n.n AS active_nodes, edges_n.n AS active_edges
FROM e JOIN edges_n ON e.ord = edges_n.ord JOIN nodes_n ON e.ord = nodes_n.ord {' '.join(f'LEFT JOIN {m}_{x} ON e.ord = {m}_{x}.ord' for m, x in _DEGREES.values())}""")
def grf4_ttl_state(spark, sf_dir):
    return graph.ttl_state(V.flows(spark, sf_dir), V.ORDER, _TTL).select("ord", *graph.STATE)


@query()
def grf6_replay_state(spark, sf_dir):
    return graph.replay_state(V.flows(spark, sf_dir), V.ORDER, _TTL, 86_400_000, graph.ENDS).select("ord", *graph.STATE)


@query(f"WITH {V.FLOWS}, g AS (SELECT src_ip, dst_ip, count(*) AS n FROM flows WHERE packets <= 15 GROUP BY 1, 2) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS flows, round(100.0 * (1 - CAST(count(*) AS DOUBLE) / sum(n)), 6) AS reduction FROM g")
def grf8_pair_groups(spark, sf_dir):
    return r6(flows.pair_groups(V.flows(spark, sf_dir)))


@query(f"""WITH {V.FLOWS} SELECT k_order, k_line, k_part, round(src_port / 65535.0, 6) AS l0, round(dst_port / 65535.0, 6) AS l1, round(ln(1 + dur_ms), 6) AS l2, round(ln(1 + packets), 6) AS l3, round(ln(1 + bytes) - ln(1 + packets), 6) AS l4 FROM flows""")
def grf9_leader_vector(spark, sf_dir):
    return r6(flows.leader_vector(V.flows(spark, sf_dir)).select("k_order", "k_line", "k_part", *(f"l{i}" for i in range(5))))


@query()
def grf9_leader_clusters(spark, sf_dir):
    return flows.leader_clusters(ordering.indexed(V.flows(spark, sf_dir), V.ORDER, "flow_idx"), 0.9)


# -- metrics and per-cluster aggregates, on labels and clusters made by rule --


def _judged(spark, sf_dir) -> DataFrame:
    f = V.flows(spark, sf_dir)
    return f.select("label", (F.col("bytes") > 40000).cast("int").alias("pred"), (F.col("src_ip") % 17).cast("int").alias("cluster"), (F.col("bytes") / 1000.0).alias("distance"), (F.col("k_order") * 1000 + F.col("k_line") * 100 + F.col("k_part") % 100).alias("idx"))


JUDGED = f"{V.FLOWS}, judged AS (SELECT label, CAST(bytes > 40000 AS INTEGER) AS pred, CAST(src_ip % 17 AS INTEGER) AS cluster, bytes / 1000.0 AS distance, k_order * 1000 + k_line * 100 + k_part % 100 AS idx FROM flows)"
COUNTS = "count(*) FILTER (pred = 1 AND label = 1) AS tp, count(*) FILTER (pred <> 1 AND label <> 1) AS tn, count(*) FILTER (pred = 1 AND label <> 1) AS fp, count(*) FILTER (pred <> 1 AND label = 1) AS fn"


@query(f"WITH {JUDGED} SELECT {COUNTS} FROM judged")
def agg1_confusion(spark, sf_dir):
    return profile.confusion(_judged(spark, sf_dir))


@query(f"""WITH {JUDGED}, c AS (SELECT {COUNTS} FROM judged), m AS (SELECT *, CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn)::DOUBLE ELSE 0 END AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r, CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0 END AS fpr FROM c)
SELECT tp, tn, fp, fn, round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(fpr, 6) AS fpr, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(CASE WHEN 4 * p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END, 6) AS f2 FROM m""")
def agg2_metrics(spark, sf_dir):
    return r6(profile.metrics(_judged(spark, sf_dir)))


STATS_SQL = (BASE + ", long AS (UNPIVOT (SELECT " + ", ".join(f"round({v}, 6) AS {v}" for v in graph.FEATURES) + " FROM features) ON " + ", ".join(graph.FEATURES) + """ INTO NAME feature VALUE value),
c AS (SELECT feature, value, count(*) AS n FROM long GROUP BY 1, 2), m AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS k FROM c)
SELECT l.feature, round(avg(l.value), 6) AS mean, round(max(l.value), 6) AS max, round(median(l.value), 6) AS median, round(any_value(m.value), 6) AS mode FROM long l JOIN m ON l.feature = m.feature AND m.k = 1 GROUP BY l.feature""")


@query(STATS_SQL)
def agg3_feature_stats(spark, sf_dir):
    return r6(profile.feature_stats(r6(featured(spark, sf_dir)), graph.FEATURES))


@query(f"WITH {V.FLOWS} SELECT label, count(*) AS n FROM flows GROUP BY label")
def agg4_label_counts(spark, sf_dir):
    return profile.label_counts(V.flows(spark, sf_dir))


@query(f"WITH {JUDGED} SELECT cluster, count(*) AS size, round(avg(distance), 6) AS mean, round(coalesce(stddev_samp(distance), 0), 6) AS std, round(min(distance), 6) AS min, round(max(distance), 6) AS max FROM judged GROUP BY cluster")
def agg5_cluster_stats(spark, sf_dir):
    return r6(profile.cluster_stats(_judged(spark, sf_dir)))


@query(f"WITH {JUDGED} SELECT cluster, round(CASE WHEN count(*) < 5 THEN 3.0 ELSE list_sort(list(distance))[least(CAST(floor(0.995 * count(*)) AS BIGINT), count(*) - 1) + 1] END, 6) AS radius FROM judged GROUP BY cluster")
def agg6_cluster_radius(spark, sf_dir):
    return r6(profile.cluster_radius(_judged(spark, sf_dir)))


@query(f"WITH {JUDGED} SELECT cluster, CAST(least(31, floor((greatest(2.0, least(80.0, distance)) - 2.0) / 78.0 * 32)) AS INTEGER) AS bin, count(*) AS n FROM judged GROUP BY 1, 2")
def agg7_histogram(spark, sf_dir):
    return profile.histogram(_judged(spark, sf_dir), ["cluster"], "distance", 2.0, 80.0)


@query(f"""WITH {JUDGED}, h AS (SELECT cluster, CAST(least(31, floor((greatest(2.0, least(80.0, distance)) - 2.0) / 78.0 * 32)) AS INTEGER) AS bin, count(*) AS n FROM judged GROUP BY 1, 2),
t AS (SELECT cluster, sum(n) AS total FROM h GROUP BY 1), b AS (SELECT cluster, total, CAST(range AS INTEGER) AS bin FROM t, range(32)) SELECT b.cluster, b.bin, round((coalesce(n, 0) / total::DOUBLE + {EPS}) / (1 + 32 * {EPS}), 9) AS p FROM b LEFT JOIN h ON b.cluster = h.cluster AND b.bin = h.bin""")
def agg8_pdf(spark, sf_dir):
    return profile.pdf(profile.histogram(_judged(spark, sf_dir), ["cluster"], "distance", 2.0, 80.0), ["cluster"]).withColumn("p", F.round("p", 9))


def _q(q: float, x: str = "x") -> str:
    return f"list_sort(list({x}))[CAST(floor({q} * (count(*) - 1)) AS BIGINT) + 1]"


@query(f"""WITH {JUDGED} SELECT cluster, count(*) AS n, round({_q(.25, 'distance')}, 6) AS q25, round({_q(.5, 'distance')}, 6) AS q50, round({_q(.75, 'distance')}, 6) AS q75, round({_q(.95, 'distance')}, 6) AS q95,
  round(CASE WHEN count(*) < 2 THEN 0 ELSE greatest(0, {_q(.75, 'distance')} - {_q(.25, 'distance')}) END, 6) AS iqr, round(avg(distance), 6) AS mean, round(CASE WHEN count(*) < 2 OR avg(distance) = 0 THEN 0 ELSE stddev_samp(distance) / greatest({EPS}, abs(avg(distance))) END, 6) AS cv,
  round(avg(CASE WHEN distance >= 30 THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM judged GROUP BY cluster""")
def agg9_12_robust_stats(spark, sf_dir):
    return r6(profile.robust_stats(_judged(spark, sf_dir), ["cluster"], "distance", 30.0))


PROTO = f"""{V.FLOWS}, c AS (SELECT src_ip % 100 AS pid, proto AS bin, count(*) AS n FROM flows GROUP BY 1, 2), t AS (SELECT pid, sum(n) AS total, max(bin) AS top FROM c GROUP BY 1),
b AS (SELECT pid, total, top, CAST(unnest(range(CAST(top AS BIGINT) + 1)) AS INTEGER) AS bin FROM t), p AS (SELECT b.pid, b.bin, (coalesce(n, 0) / total::DOUBLE + {EPS}) / (1 + (top + 1) * {EPS}) AS p FROM b LEFT JOIN c ON b.pid = c.pid AND b.bin = c.bin)"""


def _by_source(spark, sf_dir) -> DataFrame:
    return V.flows(spark, sf_dir).withColumn("pid", F.col("src_ip") % 100)


@query(f"WITH {PROTO} SELECT pid, bin, round(p, 9) AS p FROM p")
def agg13_protocol_pdf(spark, sf_dir):
    return profile.protocol_pdf(_by_source(spark, sf_dir), ["pid"]).withColumn("p", F.round("p", 9))


@query(f"WITH {PROTO}, q AS (SELECT pid, p, (p + {EPS}) / (sum(p) OVER w + count(*) OVER w * {EPS}) AS q FROM p WINDOW w AS (PARTITION BY pid)) SELECT pid, round(-sum(q * ln(q)), 6) AS entropy, round(sum(p * p), 6) AS hhi FROM q GROUP BY pid")
def agg14_entropy_hhi(spark, sf_dir):
    return r6(profile.entropy_hhi(profile.protocol_pdf(_by_source(spark, sf_dir), ["pid"]), ["pid"]))


@query(f"WITH {JUDGED}, m AS (SELECT median(distance) AS med FROM judged) SELECT round(any_value(med), 6) AS median, round(1.4826 * median(abs(distance - med)), 6) AS mad FROM judged, m")
def agg15_median_mad(spark, sf_dir):
    return r6(profile.median_mad(_judged(spark, sf_dir), "distance"))


def _hist_sql() -> str:
    parts = [f"SELECT src_ip % 100 AS pid, '{d}' AS dist, {v} AS x, {lo} AS lo, {hi} AS hi FROM features" for d, v in profile.SOURCES.items() for lo, hi in [profile.RANGES[d]]]
    return f"""vals AS ({' UNION ALL '.join(parts)}), h AS (SELECT pid, dist, CAST(least(31, floor((greatest(lo, least(hi, x)) - lo) / (hi - lo) * 32)) AS INTEGER) AS bin, count(*) AS n FROM vals GROUP BY 1, 2, 3),
  ht AS (SELECT pid, dist, sum(n) AS total FROM h GROUP BY 1, 2), hb AS (SELECT pid, dist, total, CAST(range AS INTEGER) AS bin FROM ht, range(32)),
  pc AS (SELECT src_ip % 100 AS pid, CAST(v13 AS INTEGER) AS bin, count(*) AS n FROM features GROUP BY 1, 2), pt AS (SELECT pid, sum(n) AS total, max(bin) AS top FROM pc GROUP BY 1), pb AS (SELECT pid, total, top, CAST(unnest(range(top + 1)) AS INTEGER) AS bin FROM pt),
  dist AS (SELECT hb.pid, hb.dist, hb.bin, (coalesce(n, 0) / total::DOUBLE + {EPS}) / (1 + 32 * {EPS}) AS p FROM hb LEFT JOIN h ON hb.pid = h.pid AND hb.dist = h.dist AND hb.bin = h.bin
    UNION ALL SELECT pb.pid, 'proto', pb.bin, (coalesce(n, 0) / total::DOUBLE + {EPS}) / (1 + (top + 1) * {EPS}) FROM pb LEFT JOIN pc ON pb.pid = pc.pid AND pb.bin = pc.bin)"""


def _cv(x: str) -> str:
    return f"CASE WHEN count(*) < 2 OR avg({x}) = 0 THEN 0 ELSE stddev_samp({x}) / greatest({EPS}, abs(avg({x}))) END"


def _iqr(x: str) -> str:
    return f"CASE WHEN count(*) < 2 THEN 0 ELSE greatest(0, {_q(.75, x)} - {_q(.25, x)}) END"


def _places(column: str) -> int:
    """Places that a signature value is rounded to: durations are up to 1e11 ms."""
    return 0 if column == "duration_median" else 5


def _signature_sql() -> str:
    cols = {
        "log_bytes_mean": "avg(v7)", "log_packets_mean": "avg(v8)", "duration_median": _q(0.5, "greatest(0, exp(v9) - 1)"), "bandwidth_p50": _q(0.5, "v10"), "bandwidth_p95": _q(0.95, "v10"), "bandwidth_cv": _cv("v10"),
        "pps_cv": _cv("v11"), "packet_size_mean": "avg(v12)", "packet_size_cv": _cv("v12"), "src_out_mean": "avg(v0)", "src_out_iqr": _iqr("v0"), "dst_in_mean": "avg(v2)", "dst_in_iqr": _iqr("v2"), "imbalance_p95": _q(0.95, "0.5 * (v4 + v5)"),
        "edge_count_mean": "avg(v6)", "density_mean": "avg(v16)", "rarity_mean": "avg(v19)", "rarity_p95": _q(0.95, "v19"), "scan_mean": "avg(v18)", "scan_fraction": "avg(CASE WHEN v18 >= 0.8 THEN 1.0 ELSE 0.0 END)",
    }
    return f"""{BASE}, {_hist_sql()},
q AS (SELECT *, (p + {EPS}) / (sum(p) OVER w + count(*) OVER w * {EPS}) AS q FROM dist WINDOW w AS (PARTITION BY pid, dist)),
e AS (SELECT pid, -sum(q * ln(q)) FILTER (dist = 'proto') AS proto_entropy, sum(p * p) FILTER (dist = 'proto') AS proto_hhi, -sum(q * ln(q)) FILTER (dist = 'sdeg') AS src_degree_entropy, -sum(q * ln(q)) FILTER (dist = 'ddeg') AS dst_degree_entropy FROM q GROUP BY pid),
s AS (SELECT src_ip % 100 AS pid, count(*) AS n, {", ".join(f"round({e}, {_places(c)}) AS {c}" for c, e in cols.items())} FROM features GROUP BY 1)
SELECT s.*, {", ".join(f"round({c}, 5) AS {c}" for c in ("proto_entropy", "proto_hhi", "src_degree_entropy", "dst_degree_entropy"))} FROM s JOIN e ON s.pid = e.pid"""


#: The features, over stored states, that several queries of one application read: (application, tables' folder) -> table.
_FEATURED: dict[tuple[str, str], DataFrame] = {}


def _partitioned(spark, sf_dir) -> DataFrame:
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _FEATURED:
        _FEATURED[key] = featured(spark, sf_dir).withColumn("pid", F.col("src_ip") % 100)
    return _FEATURED[key]


@query(_signature_sql())
def agg16_signature(spark, sf_dir):
    s = profile.signature(_partitioned(spark, sf_dir))
    return s.select("pid", "n", *(F.round(c, _places(c)).alias(c) for c in profile.SIGNATURE))


@query(f"WITH {JUDGED}, f AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance DESC, idx) AS k FROM judged), l AS (SELECT cluster FROM judged GROUP BY cluster ORDER BY avg(distance) DESC, cluster LIMIT 1) SELECT cluster, idx, round(distance, 6) AS distance, cluster IN (SELECT cluster FROM l) AS loosest FROM f WHERE k = 1")
def agg17_farthest_points(spark, sf_dir):
    j = _judged(spark, sf_dir)
    loose = profile.loosest_cluster(j).select("cluster", F.lit(True).alias("loosest"))
    return r6(profile.farthest_points(j).join(loose, "cluster", "left").select("cluster", "idx", "distance", F.coalesce("loosest", F.lit(False)).alias("loosest")))


@query(f"WITH {JUDGED} SELECT cluster, count(*) AS n FROM judged GROUP BY cluster ORDER BY n DESC, cluster LIMIT 1")
def agg18_majority(spark, sf_dir):
    return profile.majority(_judged(spark, sf_dir))


# -- divergences and selection --

SCORES = f"""{BASE}, {_hist_sql()},
pairs AS (SELECT a.pid AS a, b.pid AS b, a.dist, a.bin, a.p + {EPS} AS p, b.p + {EPS} AS q FROM dist a JOIN dist b ON a.dist = b.dist AND a.bin = b.bin AND a.pid <> b.pid),
tot AS (SELECT *, p / sum(p) OVER w AS x, q / sum(q) OVER w AS y FROM pairs WINDOW w AS (PARTITION BY a, b, dist)),
jd AS (SELECT a, b, dist, greatest(0, sum(0.5 * x * ln(x / (0.5 * (x + y))) + 0.5 * y * ln(y / (0.5 * (x + y))))) AS js FROM tot GROUP BY 1, 2, 3),
js AS (SELECT a, b, avg(js) AS js FROM jd GROUP BY 1, 2), scores AS (SELECT a AS pid, round({_q(.5, 'js')}, 9) AS score FROM js GROUP BY a)"""


def _scores(spark, sf_dir) -> DataFrame:
    arrays = stored(divergence.dense(profile.distributions(_partitioned(spark, sf_dir))), "distributions")
    return stored(divergence.partition_scores(arrays).withColumn("score", F.round("score", 9)), "scores")


@query(f"{SCORES} SELECT a, b, round(js, 6) AS js FROM js")
def ml5_pairwise_js(spark, sf_dir):
    return r6(divergence.pairwise(stored(divergence.dense(profile.distributions(_partitioned(spark, sf_dir))), "distributions")))


@query(f"{SCORES} SELECT pid, round(score, 6) AS score FROM scores")
def ml6_partition_scores(spark, sf_dir):
    return r6(_scores(spark, sf_dir))


TAU = f"{SCORES}, med AS (SELECT median(score) AS med, count(*) AS n FROM scores), tau AS (SELECT med, any_value(n) AS n, 1.4826 * median(abs(score - med)) AS mad, {_q(.95, 'score')} AS q95 FROM scores, med GROUP BY med), top AS (SELECT *, greatest(med + 2.5 * mad, q95) AS tau FROM tau)"


@query(f"{TAU} SELECT n, round(med, 6) AS median, round(mad, 6) AS mad, round(q95, 6) AS q95, round(tau, 6) AS tau FROM top")
def top2_threshold(spark, sf_dir):
    return r6(divergence.threshold(_scores(spark, sf_dir)).select("n", "median", "mad", "q95", "tau"))


@query(f"""{TAU}, l AS (SELECT pid, score, tau, n, row_number() OVER (ORDER BY score DESC, pid) AS place, sum(CAST(score >= tau AS INTEGER)) OVER () AS above FROM scores, top)
SELECT pid, round(score, 6) AS score, place, round(tau, 6) AS tau, place <= CASE WHEN above < greatest(5, n // 100) THEN least(greatest(5, n // 100), n) WHEN above > greatest(1, floor(n * 0.1)) THEN greatest(1, floor(n * 0.1)) ELSE above END AS selected FROM l""")
def top1_selection(spark, sf_dir):
    return r6(divergence.selection(_scores(spark, sf_dir)))


def _p_q(spark, sf_dir) -> DataFrame:
    e = V.table(spark, sf_dir, "embeddings")
    share = lambda n, m: F.transform(F.slice("embedding", n, m), lambda x: F.abs(x.cast("double")))
    return e.select("vec_id", share(1, 20).alias("p"), share(21, 44).alias("q"))


P_Q = """v AS (SELECT vec_id, i, coalesce(abs(CAST(embedding[i] AS DOUBLE)), 0) * CAST(i <= 20 AS INTEGER) + 1e-12 AS p, abs(CAST(embedding[20 + i] AS DOUBLE)) + 1e-12 AS q FROM embeddings, range(1, 45) r(i)),
n AS (SELECT vec_id, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM v WINDOW w AS (PARTITION BY vec_id))"""


@query(f"WITH {P_Q} SELECT vec_id, round(greatest(0, sum(p * ln(p / q))), 6) AS kl FROM n GROUP BY vec_id")
def ml3_kl(spark, sf_dir):
    return r6(_p_q(spark, sf_dir).select("vec_id", divergence.kl(F.col("p"), F.col("q")).alias("kl")))


@query(f"WITH {P_Q}, j AS (SELECT vec_id, greatest(0, 0.5 * sum(p * ln(p / (0.5 * (p + q)))) + 0.5 * sum(q * ln(q / (0.5 * (p + q))))) AS js FROM n GROUP BY vec_id) SELECT vec_id, round(js, 6) AS js, round(sqrt(js), 6) AS js_distance FROM j")
def ml4_js(spark, sf_dir):
    return r6(_p_q(spark, sf_dir).select("vec_id", divergence.js(F.col("p"), F.col("q")).alias("js"), divergence.js_distance(F.col("p"), F.col("q")).alias("js_distance")))


@query("""WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CAST(list_reverse(embedding) AS DOUBLE[]) AS y FROM embeddings)
SELECT vec_id, round(sqrt(list_dot_product(x, x)), 6) AS norm, round(list_cosine_similarity(x, y), 6) AS cosine, round(list_distance(x, y), 6) AS distance FROM p""")
def ml8_norm_cosine(spark, sf_dir):
    x, y = F.col("embedding"), F.reverse("embedding")
    return r6(V.table(spark, sf_dir, "embeddings").select("vec_id", divergence.norm(x).alias("norm"), divergence.cosine(x, y).alias("cosine"), divergence.euclidean(x, y).alias("distance")))


_D = V.DIMENSIONS
_XS = [f"x{i}" for i in range(_D)]


@query(f"WITH {V.vectors_sql(_D)} SELECT vec_id, " + ", ".join(f"round(({x} - min({x}) OVER ()) / CASE WHEN max({x}) OVER () = min({x}) OVER () THEN 1 ELSE max({x}) OVER () - min({x}) OVER () END, 6) AS {x}" for x in _XS) + " FROM vectors")
def ml1_minmax(spark, sf_dir):
    v = V.vectors(spark, sf_dir, _D)
    return r6(scaling.fit_scaler(v, _XS).transform(v).select("vec_id", *_XS))


@query(f"WITH sig AS ({_signature_sql()}) SELECT pid, " + ", ".join(f"round(({c} - min({c}) OVER ()) / CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 1 ELSE max({c}) OVER () - min({c}) OVER () END, 4) AS {c}" for c in profile.SIGNATURE) + " FROM sig")
def ml7_scaled_signature(spark, sf_dir):
    s = stored(agg16_signature(spark, sf_dir), "signature")
    return scaling.fit_scaler(s, profile.SIGNATURE).transform(s).select("pid", *(F.round(c, 4).alias(c) for c in profile.SIGNATURE))


_CENTRES = f"c AS (SELECT label AS cluster, {', '.join(f'round(avg({x}), 6) AS c{i}' for i, x in enumerate(_XS))} FROM vectors GROUP BY label)"


@query(f"WITH {V.vectors_sql(_D)}, {_CENTRES}, d AS (SELECT vec_id, cluster, sqrt({' + '.join(f'({x} - c{i}) * ({x} - c{i})' for i, x in enumerate(_XS))}) AS distance FROM vectors, c), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS k FROM d) SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, round(distance, 6) AS distance FROM k WHERE k = 1")
def joi3_nearest_centroid(spark, sf_dir):
    import numpy as np

    v = V.vectors(spark, sf_dir, _D)
    rows = v.groupBy("label").agg(*(F.round(F.avg(x), 6).alias(x) for x in _XS)).orderBy("label").collect()  # one row for each label
    model = learners.KMeans(_XS, np.array([[r[x] for x in _XS] for r in rows]))
    names = F.array(*(F.lit(int(r["label"])) for r in rows))
    return r6(model.assign(v).select("vec_id", F.get(names, F.col("cluster")).alias("cluster"), "distance"))


@query(f"WITH {JUDGED}, p AS (SELECT cluster, sum(distance) AS s FROM judged GROUP BY cluster) SELECT a.cluster AS a, b.cluster AS b, round(a.s - b.s, 4) AS gap FROM p a, p b WHERE a.cluster <> b.cluster")
def joi4_theta(spark, sf_dir):
    p = stored(_judged(spark, sf_dir).groupBy("cluster").agg(F.sum("distance").alias("s")), "sums")
    a, b = p.select(F.col("cluster").alias("a"), F.col("s").alias("sa")), p.select(F.col("cluster").alias("b"), F.col("s").alias("sb"))
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", F.round(F.col("sa") - F.col("sb"), 4).alias("gap"))


@query(f"WITH {V.FLOWS}, o AS (SELECT *, row_number() OVER (ORDER BY {V.SQL_ORDER}) AS flow_idx FROM flows) SELECT flow_idx, src_ip, dst_ip, label, CAST(flow_idx % 7 = 0 AS INTEGER) AS pred FROM o")
def joi6_predictions(spark, sf_dir):
    f = ordering.indexed(V.flows(spark, sf_dir), V.ORDER, "flow_idx")
    pred = f.select("flow_idx", (F.col("flow_idx") % 7 == 0).cast("int").alias("pred"))
    return f.join(pred, "flow_idx").select("flow_idx", "src_ip", "dst_ip", "label", "pred")


@query(f"WITH {JUDGED}, s AS (SELECT cluster FROM judged GROUP BY cluster HAVING avg(label) > 0.25) SELECT cluster, count(*) AS n, CAST(cluster IN (SELECT cluster FROM s) AS INTEGER) AS selected FROM judged GROUP BY cluster")
def joi7_semi_anti(spark, sf_dir):
    j = _judged(spark, sf_dir)
    s = j.groupBy("cluster").agg(F.avg("label").alias("a")).where("a > 0.25").select("cluster")
    count = lambda d, x: d.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("selected", F.lit(x))
    return count(j.join(s, "cluster", "left_semi"), 1).union(count(j.join(s, "cluster", "left_anti"), 0))


@query("SELECT i AS n, round(CASE WHEN i <= 1 THEN 0 ELSE 2 * (ln(i - 1) + 0.5772156649015329) - 2 * (i - 1) / i::DOUBLE END, 9) AS c FROM range(1, 2001) r(i)")
def det3_expected_path(spark, sf_dir):
    return spark.range(1, 2001).select(F.col("id").alias("n"), F.round(learners.expected_path(F.col("id").cast("double")), 9).alias("c"))
