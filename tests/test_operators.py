import io
import json
import math
import struct
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom import config
from netloom.config import DbstreamConfig, IForestConfig
from netloom.functions import codes
from netloom.operators import detectors, divergence, flows, graph, joins, learners, ordering, profile, scaling
from netloom.plans import model_queries as M
from netloom.plans import views as V
from netloom.sinks import writers
from netloom.sources import loaders, pcap, readers

# -- sessionization --


def packets(spark, rows):
    df = spark.createDataFrame([(i, "4", s, 2, 3, 4, u, c, n, y, 4) for i, (s, u, c, n, y) in enumerate(rows)], "pkt_idx long, kind string, src long, dst long, sport int, dport int, us long, code int, len int, label int, stack int")
    return df.withColumn("ts", F.timestamp_micros("us"))


def test_gap_equal_to_the_time_out_splits(spark):
    p = packets(spark, [(1, 0, 17, 60, 0), (1, 9_000_000, 33, 52, 0), (1, 19_000_000, 65, 52, 1), (2, 5, 1, 7, 1), (1, 28_999_999, 1, 1, 0)])
    got = sorted((r.src, r.sid, r.packets, r.bytes, r.code, r.label) for r in flows.sessionize(p, 10_000_000).collect())
    assert got == [(1, 1, 2, 112, 49, 0), (1, 2, 2, 53, 65, 1), (2, 1, 1, 7, 1, 1)]


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_results_do_not_depend_on_partitions(spark, sf_dir, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        f = V.flows(spark, sf_dir, 60).where("k_order % 5 = 0")
        got = graph.cumulative_state(f, V.ORDER).orderBy("ord").select(*graph.STATE).collect()
        assert [tuple(r) for r in got] == sequential(f)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_replay_with_dense_traffic_agrees_with_the_gap_rule(spark):
    p = packets(spark, [(i % 3, i * 1_000_000, 1, 1, 0) for i in range(60)] + [(7, 200_000_000, 1, 1, 1)])
    assert sorted(r.packets for r in flows.replay(p, chunks=4).collect()) == sorted(r.packets for r in flows.sessionize(p, 10_000_000).collect())


def test_streamed_sessions_equal_batch_sessions(spark, sf_dir):
    a = sorted((r.src, r.start_us, r.end_us, r.packets, r.bytes) for r in M.str1_session_stream(spark, sf_dir).collect())
    b = flows.sessionize(V.packets(spark, sf_dir), 6 * M.HOUR, ["src"])
    assert a == sorted((r.src, r.s, r.e, r.packets, r.bytes) for r in b.select("src", codes.micros(F.col("ts_start")).alias("s"), codes.micros(F.col("ts_end")).alias("e"), "packets", "bytes").collect())


# -- graph --


def ordered(f):
    return [(r.src_ip, r.dst_ip, r.t, r.e) for r in f.orderBy(*V.ORDER).select("src_ip", "dst_ip", codes.millis(F.col("ts_start")).alias("t"), codes.millis(F.col("ts_end")).alias("e")).collect()]


def sequential(f, ttl=None):
    """State after each flow; ttl: an edge lives to the latest ts_end + ttl of its flows."""
    edges, rows, nodes = {}, [], set()
    for s, d, t, e in ordered(f):
        if ttl is not None:
            edges = {k: v for k, v in edges.items() if v[1] >= t}
        n, until = edges.get((s, d), (0, -(1 << 60)))
        edges[s, d] = n + 1, max(until, max(t, e) + (ttl or 0))
        nodes = {x for k in edges for x in k} if ttl is not None else nodes | {s, d}
        out = lambda x: sum(k[0] == x for k in edges)
        into = lambda x: sum(k[1] == x for k in edges)
        rows.append((out(s), into(s), into(d), out(d), n + 1, len(nodes), len(edges)))
    return rows


def test_ttl_state_against_a_sequential_graph(spark, sf_dir):
    f = V.flows(spark, sf_dir, 25).where("k_order % 9 = 0")
    ttl = 3 * 86_400_000
    got = graph.ttl_state(f, V.ORDER, ttl).orderBy("ord").select(*graph.STATE).collect()
    assert [tuple(r) for r in got] == sequential(f, ttl)


def test_replay_without_expiry_is_cumulative(spark, sf_dir):
    f = V.flows(spark, sf_dir, 25).where("k_order % 9 = 0")
    rows = [[tuple(r) for r in s.orderBy("ord").select(*graph.STATE).collect()] for s in (graph.replay_state(f, V.ORDER, 1 << 50), graph.cumulative_state(f, V.ORDER))]
    assert rows[0] == rows[1]


def replayed(f, order, ttl, prune):
    g = graph.ReplayGraph(ttl, prune)
    return [g.step(r.src_ip, r.dst_ip, r.t, r.e) for r in f.orderBy(*order).select("src_ip", "dst_ip", codes.millis(F.col("ts_start")).alias("t"), codes.millis(F.col("ts_end")).alias("e")).collect()]


@pytest.mark.parametrize(("days", "every", "order"), [(10, 1, V.ORDER), (0, 0, V.ORDER), (3, 40, V.ORDER), (60, 2, V.ORDER), (10, 1, ["k_order", "k_line", "k_part", "k_supp", "k_ship"])])
def test_replay_in_steps_against_the_sequential_graph(spark, sf_dir, monkeypatch, days, every, order):
    """Self-loops, times that go back in the order, and more than one step of edges, nodes and flows."""
    f = V.flows(spark, sf_dir, 12).where("k_order % 5 = 0")
    names = []

    def kept(df, name, store=graph.stored):
        names.append(name)
        return store(df, name)

    monkeypatch.setattr(graph, "stored", kept)
    monkeypatch.setattr(graph, "FLOWS_AT_A_TIME", 700)
    got = graph.replay_state(f, order, days * 86_400_000, every * 86_400_000, ["label"])
    assert got.columns == ["label", "ord", *graph.STATE]
    assert [tuple(r) for r in got.orderBy("ord").select(*graph.STATE).collect()] == replayed(f, order, days * 86_400_000, every * 86_400_000)
    assert names.count("edges") == names.count("node_sums") == 2


def test_replay_of_no_flows(spark, sf_dir):
    assert graph.replay_state(V.flows(spark, sf_dir).where("k_order < 0"), V.ORDER, 1000).collect() == []


def test_replay_expires_at_the_earliest_timer():
    g = graph.ReplayGraph(10, 5)
    assert g.step(1, 2, 0, 0)[-2:] == (2, 1)
    assert g.step(1, 2, 4, 4)[4] == 2
    assert g.step(3, 4, 11, 11)[-2:] == (2, 1)  # the refreshed edge went at its first timer
    assert g.step(1, 2, 30, 30)[4] == 1


def test_empty_graph_features(spark, sf_dir):
    f = graph.features(graph.state(V.flows(spark, sf_dir).limit(50), V.ORDER, "empty"), ["ord"]).collect()
    assert all(r[f"v{i}"] == 0 for r in f for i in (0, 1, 2, 3, 4, 5, 6, 14, 15, 16, 17, 18)) and all(r.v19 == 1 for r in f)
    with pytest.raises(ValueError, match="mode"):
        graph.state(V.flows(spark, sf_dir), V.ORDER, "other")


def test_indexes_are_dense(spark):
    df = spark.range(1000).withColumn("x", F.xxhash64("id"))
    rows = ordering.indexed(df, ["x"], "n").orderBy("x").collect()
    assert [r.n for r in rows] == list(range(1, 1001))


# -- aggregates --


def test_edges_of_statistics(spark):
    one = spark.createDataFrame([(1, 5.0)], "k int, v double")
    r = profile.robust_stats(one, ["k"], "v", 1.0).first()
    assert (r.iqr, r.cv, r.q95, r.fraction) == (0.0, 0.0, 5.0, 1.0)
    empty = profile.metrics(spark.createDataFrame([], "pred int, label int")).first()
    assert empty.accuracy == empty.f1 == empty.f2 == empty.fpr == 0
    ten = spark.createDataFrame([(1, float(i)) for i in range(1, 11)], "k int, v double")
    assert profile.lower_quantile(ten, ["k"], "v", 0.95, "q").first().q == 9.0
    few = spark.createDataFrame([(0, 1.0)] * 4 + [(1, float(i)) for i in range(5)], "cluster int, distance double")
    assert {r.cluster: r.radius for r in profile.cluster_radius(few).collect()} == {0: 3.0, 1: 4.0}
    p = profile.pdf(profile.histogram(ten, ["k"], "v", 0.0, 10.0), ["k"]).agg(F.sum("p")).first()[0]
    assert p == pytest.approx(1)


def test_divergence_bounds(spark):
    rows = [(1, [1.0, 0.0], [0.0, 1.0]), (2, [0.5, 0.5], [0.5, 0.5]), (3, [1.0], [0.2, 0.3, 0.5]), (4, [], [1.0])]
    got = {r.i: r for r in spark.createDataFrame(rows, "i int, p array<double>, q array<double>").select("i", divergence.js(F.col("p"), F.col("q")).alias("js"), divergence.js_truncated(F.col("p"), F.col("q")).alias("cut"), divergence.kl(F.col("p"), F.col("q")).alias("kl")).collect()}
    assert got[1].js == pytest.approx(math.log(2), abs=1e-6) and got[2].js == pytest.approx(0, abs=1e-9)
    assert got[3].cut == pytest.approx(0, abs=1e-9) and got[3].js > 0.1 and got[4].cut == 0
    assert all(0 <= r.js <= math.log(2) + 1e-9 and r.kl >= 0 for r in got.values())


def test_a_partition_alone_scores_zero(spark):
    one = spark.createDataFrame([(7, "bw", [1.0, 0.0])], "pid long, dist string, p array<double>")
    scores = divergence.partition_scores(one)
    assert [tuple(r) for r in scores.collect()] == [(7, 0.0)]
    assert [r.selected for r in divergence.selection(scores).collect()] == [True]


def test_scaling_and_pca(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i, 4.0) for i in range(20)], "i int, a double, b double, c double")
    s = scaling.fit_scaler(df, ["a", "c"]).transform(df).agg(F.min("a"), F.max("a"), F.max("c")).first()
    assert tuple(s) == (0.0, 1.0, 0.0)
    xy = scaling.pca_2d(df, ["a", "b", "c"], ["i"]).toPandas()
    assert xy.x.std() == pytest.approx(np.sqrt(5) * df.toPandas().a.std()) and abs(xy.y).max() < 1e-9 and abs(xy.x.mean()) < 1e-9


# -- learners --


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(500)] + [(500, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double")
    got = learners.fit_iforest(df, ["a", "b", "c"], IForestConfig(n_trees=50), "i").score(df).orderBy(F.desc("score")).collect()
    assert got[0].i == 500 and all(0 < r.score <= 1 for r in got)


def test_trees_of_a_large_table_share_no_rows(spark):
    df = spark.range(3000).select("id", F.col("id").cast("double").alias("a"))
    cfg = IForestConfig(n_trees=20, sample_size=64)
    rows = learners.tree_rows(df, ["a"], cfg, "id").select("tree", "a").collect()
    assert Counter(r.tree for r in rows) == {t: 64 for t in range(20)} and len({r.a for r in rows}) == 20 * 64
    small = learners.fit_iforest(df.where("id < 1000"), ["a"], cfg, "id")
    assert small.sample_size == 64 and [int(t.size[0]) for t in small.trees] == [64] * 20
    assert learners.fit_iforest(df.where("id < 0"), ["a"], cfg, "id").trees == []


def plain_dbscan(x, eps, least):
    near = [set(np.flatnonzero(((x - p) ** 2).sum(1) <= eps * eps).tolist()) for p in x]
    core = {i for i, s in enumerate(near) if len(s) >= least}
    out = {}
    for i in sorted(core):
        if i in out:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in out:
                out[j] = i
                todo += [k for k in near[j] if k in core and k not in out]
    return [out.get(i, min((out[j] for j in near[i] if j in core), default=None)) for i in range(len(x))]


def test_dbscan_against_a_plain_one(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.15, (40, 3)) for c in (0, 1, 2)] + [rng.uniform(-1, 3, (30, 3)), np.full((15, 3), 5.0)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "idx long, a double, b double, c double")
    got = [r.cluster for r in learners.dbscan(df, ["a", "b", "c"], 0.25, 5).orderBy("idx").collect()]
    assert got == plain_dbscan(x, 0.25, 5)


def test_dbscan_of_dealt_cells_and_rows_without_a_place(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.02, (120, 4)), rng.normal(1, 0.4, (60, 4)), rng.uniform(-1, 3, (40, 4)), np.full((9, 4), 2.0)])
    names = ["a", "b", "c", "d"]
    made = lambda rows: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "idx long, a double, b double, c double, d double")
    monkeypatch.setattr(learners, "CELL_POINTS", 7)
    monkeypatch.setattr(joins, "MAX_BROADCAST_KEYS", 0)
    lost = spark.createDataFrame([(900, None, 0.0, 0.0, 0.0), (901, float("nan"), 0.0, 0.0, 0.0), (902, float("inf"), 0.0, 0.0, 0.0)], made(x).schema)
    rows = learners.dbscan(made(x).union(lost), names, 0.2, 4).orderBy("idx").collect()
    assert [r.cluster for r in rows] == [*plain_dbscan(x, 0.2, 4), None, None, None]
    assert learners.dbscan(made(x[:0]), names, 0.2, 4).count() == 0
    assert [r.cluster for r in learners.dbscan(made(x[:1]), names, 0.2, 1).collect()] == [0]
    with pytest.raises(ValueError, match="epsilon"):
        learners.dbscan(made(x), names, 0.0, 4)


def test_dbstream_rules():
    s = learners.Dbstream(DbstreamConfig(epsilon=1.0, lambda_=0.01, mu=2.0, beta_noise=0.5, max_clusters=2, eta=0.1, connection=0.1))
    s.insert(np.array([0.0, 0.0]), 10.0)
    s.insert(np.array([0.5, 0.0]), 9.0)  # late
    assert s.inserted == 1 and len(s.centres) == 1
    for t in range(11, 15):
        s.insert(np.array([0.1, 0.0]), float(t))
    s.insert(np.array([9.0, 9.0]), 15.0)
    s.insert(np.array([-9.0, 9.0]), 16.0)  # no room
    assert len(s.centres) == 2 and s.core() == [0]
    labels = s.macro_labels()
    assert s.assign(np.array([0.2, 0.0]), labels) == 0 and s.assign(np.array([9.0, 9.0]), labels) == -1
    s.reset()
    assert not s.centres


class PlainStream:
    """A sequential stream clustering over lists, one cluster after another."""

    def __init__(self, cfg):
        self.cfg, self.clusters, self.links, self.inserts, self.last = cfg, [], {}, 0, 0.0

    def far(self, a, b):
        return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))

    def clean(self):
        weak = {c["id"] for c in self.clusters if c["w"] < self.cfg.beta_noise}
        self.clusters = [c for c in self.clusters if c["id"] not in weak]
        self.links = {k: v for k, v in self.links.items() if not weak & set(k)}

    def insert(self, x, t):
        if t < self.last:
            return
        for c in self.clusters:
            c["w"] *= math.exp(-self.cfg.lambda_ * (t - c["t"]))
            c["t"] = t
        hit = [c for c in self.clusters if self.far(c["c"], x) < self.cfg.epsilon]
        if hit:
            for c in hit:
                c["w"] += 1
            pull = [self.cfg.eta * math.exp(-(self.far(c["c"], x) ** 2) / (2 * self.cfg.epsilon**2)) for c in hit]
            moved = [[a + p * (b - a) for a, b in zip(c["c"], x, strict=True)] for c, p in zip(hit, pull, strict=True)]
            if all(self.far(a, b) >= self.cfg.epsilon for i, a in enumerate(moved) for b in moved[i + 1 :]):
                for c, m in zip(hit, moved, strict=True):
                    c["c"] = m
            for i, a in enumerate(hit):
                for b in hit[i + 1 :]:
                    w, seen, _ = self.links.get((a["id"], b["id"]), (0.0, t, 0.0))
                    w = w * math.exp(-self.cfg.lambda_ * (t - seen)) + 1
                    self.links[a["id"], b["id"]] = (w, t, 2 * w / (a["w"] + b["w"]))
        else:
            if len(self.clusters) >= self.cfg.max_clusters:
                self.clean()
                if len(self.clusters) >= self.cfg.max_clusters:
                    return
            self.clusters.append({"id": self.inserts, "c": list(x), "w": 1.0, "t": t})
        self.inserts += 1
        if self.inserts % 100 == 0:
            self.clean()
        self.last = t

    def assigned(self, points):
        core = [c for c in self.clusters if c["w"] >= self.cfg.mu]
        group = {c["id"]: c["id"] for c in core}
        for (a, b), (_, _, connection) in self.links.items():
            if a in group and b in group and connection >= self.cfg.connection:
                old, new = group[a], group[b]
                group = {k: new if v == old else v for k, v in group.items()}
        labels = {}
        for c in core:
            labels.setdefault(group[c["id"]], len(labels))
        out = []
        for x in points:
            d, best = min(((self.far(c["c"], x), labels[group[c["id"]]]) for c in core), default=(math.inf, -1))
            out.append(best if d <= 1.5 * self.cfg.epsilon else -1)
        return out


@pytest.mark.parametrize("cfg", [dict(epsilon=0.1, mu=3.0, lambda_=0.01, connection=0.3, max_clusters=60), dict(epsilon=0.15, mu=2.0, lambda_=0.01, connection=0.2, max_clusters=8, beta_noise=0.8)])
def test_dbstream_against_a_sequential_model(spark, cfg):
    rng = np.random.default_rng(4)
    rows = [(p, p * 1000 + i, float(t), *map(float, np.clip(rng.normal(rng.choice([0.2, 0.5, 0.8]), 0.08, 2), 0, 1))) for p in range(3) for i, t in enumerate(np.sort(rng.integers(0, 400, 350)))]
    df = spark.createDataFrame(rows, "pid long, flow_idx long, t double, a double, b double").repartition(4)
    cfg = DbstreamConfig(**({"eta": 0.15, "beta_noise": 0.5} | cfg))
    got = {r.flow_idx: (r.assignment, r.x, r.y) for r in learners.dbstream_partitions(df, ["a", "b"], cfg).collect()}
    for p in range(3):
        part = [r for r in rows if r[0] == p]
        x = np.array([r[3:] for r in part])
        x = (x - x.min(0)) / (x.max(0) - x.min(0))
        plain = PlainStream(cfg)
        for v, r in zip(x.tolist(), part, strict=True):
            plain.insert(v, r[2])
        want = plain.assigned(x.tolist())
        assert [got[r[1]][0] for r in part] == want
        centred = x - x.mean(0)
        assert np.abs([got[r[1]][1:] for r in part]) == pytest.approx(np.abs(centred @ np.linalg.svd(centred, full_matrices=False)[2].T), abs=1e-9)


def test_greedy_partitions_against_a_plain_one(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 30, (400, 2)))]
    df = spark.createDataFrame(rows, "flow_idx long, src_ip long, dst_ip long").repartition(3)
    load, seen, want = [0] * 7, [set() for _ in range(7)], []
    for _, a, b in rows:
        most = max(load) + 1
        score = [(a in s) + (b in s) - n / most for s, n in zip(seen, load, strict=True)]
        p = score.index(max(score))
        load[p] += 1
        seen[p] |= {a, b}
        want.append(p)
    for bits in (None, 1 << 14):
        assert [r.pid for r in learners.greedy_partitions(df, 7, bits=bits).orderBy("flow_idx").collect()] == want


def test_leader_clusters_against_a_plain_one(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(a), int(b), int(p), 80, 1, 1_000_000 * i, 1_000_000 * (i + int(d)), int(n), int(m)) for i, (a, b, p, d, n, m) in enumerate(zip(*rng.integers(0, [[3], [2], [65000], [50], [40], [90000]], (6, 300)), strict=True))]
    df = spark.createDataFrame(rows, "flow_idx long, src_ip long, dst_ip long, src_port int, dst_port int, proto int, s long, e long, packets long, bytes long")
    df = df.withColumn("ts_start", F.timestamp_micros("s")).withColumn("ts_end", F.timestamp_micros("e"))
    vectors = {r.flow_idx: (r.src_ip, r.dst_ip, [r.l0, r.l1, r.l2, r.l3, r.l4]) for r in flows.leader_vector(df).collect()}
    groups, want = {}, {}
    for i in sorted(vectors):
        a, b, x = vectors[i]
        centres = groups.setdefault((a, b), [])
        dot = lambda u, v: sum(p * q for p, q in zip(u, v, strict=True))
        for j, (c, n) in enumerate(centres):
            if dot(c, c) > 0 and dot(x, x) > 0 and dot(c, x) / math.sqrt(dot(c, c) * dot(x, x)) >= 0.9:
                centres[j] = ([(p * n + q) / (n + 1) for p, q in zip(c, x, strict=True)], n + 1)
                want[i] = j
                break
        else:
            want[i] = len(centres)
            centres.append((x, 1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {r.flow_idx: r.leader for r in flows.leader_clusters(df, 0.9).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_order_statistics_with_hot_values_and_nulls(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 5 == 0 else i % 3, 7.0 if rng.random() < 0.5 else float(rng.integers(0, 50))) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: (r.n, r.a, r.b) for r in profile.order_statistics(df, ["k"], "v", {"a": lambda n: F.lit(1), "b": lambda n: F.floor(n / 2) + 1}).collect()}
    for k in (None, 0, 1, 2):
        v = sorted(x for j, x in rows if j == k)
        assert got[k] == (len(v), v[0], v[len(v) // 2])
    stats = profile.feature_stats(df, ["v"]).first()
    values = [x for _, x in rows]
    assert (stats["median"], stats["mode"]) == (np.median(values), 7.0)
    m = profile.median_mad(df, "v").first()
    assert m["mad"] == pytest.approx(1.4826 * np.median(np.abs(np.array(values) - m["median"])))


def test_partition_outlier_rules(spark):
    rows = [(0, i, float(i), 0.0 if i < 30 else 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "pid long, flow_idx long, t double, x double")
    cfg = dict(epsilon=0.3, lambda_=0.0001, mu=3.0, beta_noise=0.1, max_clusters=10)
    a = learners.dbstream_partitions(df, ["x"], DbstreamConfig(**cfg)).collect()
    assert all(r.is_outlier == (r.assignment >= 0) for r in a)
    b = learners.dbstream_partitions(df, ["x"], DbstreamConfig(**cfg, outlier_rule="comment")).collect()
    assert sum(r.is_outlier for r in b) == 30


def test_bloom_and_greedy_partitions(spark):
    b = learners.Bloom(1 << 12)
    for i in range(50):
        b.insert(i)
    b.insert(b"abc")
    assert all(i in b for i in range(50)) and b"abc" in b and sum(i in b for i in range(1000, 2000)) < 20
    b.clear()
    assert 1 not in b
    with pytest.raises(ValueError):
        learners.Bloom(1000)
    df = spark.createDataFrame([(1, 1, 2), (2, 3, 4), (3, 1, 2), (4, 3, 4), (5, 1, 4)], "flow_idx long, src_ip long, dst_ip long")
    assert [r.pid for r in learners.greedy_partitions(df, 3).orderBy("flow_idx").collect()][:2] == [0, 1]


def test_detectors_run_end_to_end(spark, sf_dir):
    f = M._split(spark, sf_dir)
    for name in ("IForest", "DBSCAN"):
        r = detectors.detect(f.where("flow_idx % 10 = 0 OR NOT is_train").limit(900), config.EngineConfig(algorithm=name))
        m = r.metrics.first()
        assert m.tp + m.tn + m.fp + m.fn == r.predictions.count()
        assert 0 <= m.accuracy <= 1 and {"x", "y"} <= set(r.tables["pca"].columns)
    with pytest.raises(ValueError, match="algorithm"):
        detectors.detect(f, config.EngineConfig(algorithm="?"))


# -- sources and sinks --


def frame(payload, kind=0x0800):
    return b"\0" * 12 + struct.pack("!H", kind) + payload


def ip4(proto, l4, src=(10, 0, 0, 1), dst=(10, 0, 0, 2)):
    return struct.pack("!BBHHHBBH4B4B", 0x45, 0, 20 + len(l4), 0, 0, 64, proto, 0, *src, *dst) + l4


TCP = struct.pack("!HHIIBBHHH", 1234, 80, 0, 0, 5 << 4, 2, 0, 0, 0)
UDP = struct.pack("!HHHH", 5353, 53, 8, 0)


def capture(order="<", nano=False):
    magic = {("<", False): b"\xd4\xc3\xb2\xa1", (">", False): b"\xa1\xb2\xc3\xd4", ("<", True): b"\x4d\x3c\xb2\xa1"}[order, nano]
    ip6 = struct.pack("!IHBB", 6 << 28, len(UDP), 17, 64) + (1).to_bytes(16, "big") + (2).to_bytes(16, "big") + UDP
    data = [frame(ip4(6, TCP)), frame(ip4(17, UDP)), frame(ip4(1, b"\0" * 8)), frame(ip4(2, b"\0" * 8)), frame(ip4(99, b"")), frame(ip6, 0x86DD), frame(b"\0" * 28, 0x0806)]
    out = magic + struct.pack(order + "HHIIII", 2, 4, 0, 0, 65535, 1)
    for i, d in enumerate(data):
        out += struct.pack(order + "IIII", 100 + i, 7000 if nano else 7, len(d), len(d)) + d
    return out + b"\0" * 5


@pytest.mark.parametrize(("order", "nano"), [("<", False), (">", False), ("<", True)])
def test_packet_decode(order, nano):
    rows = list(pcap.packets(io.BytesIO(capture(order, nano)), "f"))
    assert [r[2] for r in rows] == ["4"] * 5 + ["6", "bad"] and rows[0][9] == 100_000_007
    assert [r[10] for r in rows[:6]] == [1 | 16, 1 | 256, 1 | 4, 1 | 8, 1 | 512, 2 | 256]
    assert rows[0][3:5] == (0x0A000001, 0x0A000002) and rows[0][7:9] == (1234, 80) and rows[5][5:7] == ("1", "2") and rows[0][11] == 40


def test_pcap_sources_and_loader(spark, tmp_path):
    at = tmp_path / "a.pcap"
    at.write_bytes(capture())
    pcap.register(spark)
    assert spark.read.format("pcap").load(str(at)).count() == 7
    p = pcap.read_pcap(spark, str(at))
    assert [r.pkt_idx for r in p.orderBy("pkt_idx").collect()] == list(range(7))
    cfg = config.from_dict({"data_type": "Pcap", "data_path": str(at), "train_ratio": 0.5})
    got = loaders.load(spark, cfg).orderBy("flow_idx").collect()
    assert len(got) == 5 and [r.is_train for r in got] == [True, True, False, False, False]
    with pytest.raises(ValueError, match="data type"):
        loaders.load(spark, config.from_dict({"data_type": "x"}))


def test_packet_text_loader_and_label_count(spark, tmp_path):
    lines = ["4 167772161 167772162 1234 80 0 17 60", "4 167772161 167772162 1234 80 9000000 33 52", "4 167772161 167772162 1234 80 19000000 65 52", "6 1 2 5353 5353 20000000 258 100", "x bad line"]
    (tmp_path / "p.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "l.txt").write_text("001 00\n")
    cfg = config.from_dict({"data_type": "HyperVision", "data_path": str(tmp_path / "p.txt"), "label_path": str(tmp_path / "l.txt")})
    got = loaders.load(spark, cfg).orderBy("flow_idx").collect()
    assert [(r.packets, r.bytes, r.label) for r in got] == [(2, 112, 0), (1, 52, 1)]
    (tmp_path / "l.txt").write_text("001")
    with pytest.raises(ValueError, match="labels"):
        loaders.load(spark, cfg)
    back = readers.packet_text(readers.read_packets(spark, str(tmp_path / "p.txt"))).orderBy("pkt_idx").collect()
    assert [r.value for r in back] == lines[:4]


def test_csv_loader(spark, tmp_path):
    from netloom.plans.flow_queries import CSV_LINES

    (tmp_path / "f.csv").write_text("\n".join(["header", *CSV_LINES]) + "\n")
    cfg = config.from_dict({"data_type": "CICIDS", "data_path": str(tmp_path / "f.csv")})
    assert [(r.src_port, r.dst_port, r.label) for r in loaders.load(spark, cfg).orderBy("flow_idx").collect()] == [(1234, 80, 0), (0, 12, 1), (1, 2, 0)]
    assert loaders.load(spark, config.from_dict({"data_type": "CICIDS", "data_path": str(tmp_path / "f.csv"), "data_size": 2})).count() == 2
    bad = CSV_LINES[0].replace("7/3/2017 8:55", "yesterday")
    with pytest.raises(Exception, match="bad time"):
        readers.parse_flow_lines(spark.createDataFrame([(0, bad)], "line_no long, value string")).collect()


SHIPPED = {
    "data_loader": {"data_type": "HyperVision", "data_path": "/d/x.data", "label_path": "/d/x.label", "train_ratio": 0.7, "data_size": 9},
    "algorithm": "Mix",
    "detector": {
        "dbscan_config": {"epsilon": 0.07, "min_points": 11, "outline_threshold": 0.01},
        "iforest_config": {"random_seed": 2026, "n_trees": 101, "sample_size": 256, "max_depth": 8, "outline_threshold": 0.5},
        "dbstream_config": {"epsilon": 0.4, "lambda": 0.02, "mu": 5.0, "beta_noise": 0.15, "max_clusters": 1000, "eta": 0.15, "connection_threshold": 0.005},
    },
    "extractor": {"ttl_ms": 0, "wheel_granularity_ms": 5, "prune_interval_ms": 20},
}


def test_nested_config(spark):
    c = config.from_dict(SHIPPED)
    assert (c.data.data_type, c.data.data_path, c.data.label_path, c.data.train_ratio, c.data.data_size, c.algorithm) == ("HyperVision", "/d/x.data", "/d/x.label", 0.7, 9, "Mix")
    assert (c.dbscan.epsilon, c.dbscan.min_points, c.dbscan.outline_threshold) == (0.07, 11, 0.01)
    assert (c.iforest.random_seed, c.iforest.n_trees, c.iforest.sample_size, c.iforest.max_depth, c.iforest.outline_threshold) == (2026, 101, 256, 8, 0.5)
    b = c.dbstream
    assert (b.epsilon, b.lambda_, b.mu, b.beta_noise, b.max_clusters, b.eta, b.connection) == (0.4, 0.02, 5.0, 0.15, 1000, 0.15, 0.005)
    assert (c.graph.ttl_ms, c.graph.wheel_granularity_ms, c.graph.prune_interval_ms, c.graph.mode) == (0, 5, 20, "cumulative")
    for odd in ({"data_loader": {"path": "x"}}, {"detector": {"svm_config": {}}}, {"iforest": {"trees": 3}}, {"colour": 1}):
        with pytest.raises((ValueError, TypeError), match="unknown keys"):
            config.from_dict(odd)
    with pytest.raises(ValueError, match="partitioning"):
        config.from_dict({"partitioning": "other"})


HEADERS = {
    "RF": {"p_pred": "SrcIP,DstIP,Pred,Label", "p_metrics": "tp,tn,fp,fn,accuracy,precision,recall,fpr,f1,f2"},
    "Mini_Batch_KMeans": {"p_pred": "SrcIP,DstIP,Pred,Label", "p_train_clusters": "Index,Cluster,Distance", "p_test_clusters": "Index,SrcIP,DstIP,Cluster,Distance,Label"},
    "DBSCAN": {"p_pred": "SrcIP,DstIP,Dist,Pred,Label", "dbscan_pca_result": "x,y,assignments,label,is_outlier"},
    "IForest": {"p_pred": "SrcIP,DstIP,Score,Pred,Label", "iforest_pca_result": "x,y,pred,label"},
    "Mix": {"p_pred": "SrcIP,DstIP,Pred,Label", "dbstream_pca": "x,y,assignments,label,is_outlier,pid"},
    "Analyze": {"pca_result": "x,y,label"},
}


@pytest.mark.parametrize("name", HEADERS)
def test_every_detector_from_a_config_file_to_its_result_files(spark, tmp_path, name):
    from netloom import main

    rng = np.random.default_rng(3)
    lines, labels = [], ""
    for i in range(400):
        bad = int(rng.random() < 0.3)
        lines.append(f"4 {rng.integers(1, 20)} {rng.integers(30, 40)} {rng.integers(1, 60000)} 80 {i * 1_000_000} {17 if bad else 65} {rng.integers(40, 1500)}")
        labels += str(bad)
    (tmp_path / "p.data").write_text("\n".join(lines) + "\n")
    (tmp_path / "p.label").write_text(labels)
    shipped = json.loads(json.dumps(SHIPPED)) | {"algorithm": name, "output_dir": str(tmp_path / "out"), "partitions": 6, "partitioning": "bloom"}
    shipped["data_loader"] |= {"data_path": str(tmp_path / "p.data"), "label_path": str(tmp_path / "p.label"), "data_size": -1}
    shipped["detector"]["iforest_config"]["n_trees"] = 5
    shipped["kmeans"] = {"k": 3, "iterations": 5}
    (tmp_path / "c.json").write_text(json.dumps(shipped))
    cfg = config.load(str(tmp_path / "c.json"))
    result = main.run(spark, cfg)
    for file, header in HEADERS[name].items():
        got = spark.read.option("header", True).csv(str(tmp_path / "out" / f"{file}.csv"))
        assert ",".join(got.columns) == header and got.count()
    if result.predictions is not None:
        m = result.metrics.first()
        assert m.tp + m.tn + m.fp + m.fn == result.predictions.count()
    text = writers.report(name, result)
    assert text.startswith(name) and (name == "Analyze" or "accuracy" in text) and (name != "Mix" or "partitions selected" in text)


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a0\na1\n")
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(500)))
    (tmp_path / "c.txt").write_text("")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
    try:
        rows = readers.placed_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [r.value for r in rows] == ["a0", "a1", *(f"b{i}" for i in range(500))] and [r.line_no for r in rows] == list(range(502))
    assert [r.file_line for r in rows[:4]] == [0, 1, 0, 1]


def test_config_and_sinks(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"algorithm": "IForest", "iforest": {"n_trees": 3}, "dbstream": {"lambda": 0.5, "epsilon": 0.4}, "extractor": {"ttl_ms": 7}}))
    cfg = config.load(str(tmp_path / "c.json"))
    assert (cfg.algorithm, cfg.iforest.n_trees, cfg.iforest.sample_size, cfg.dbstream.lambda_, cfg.graph.ttl_ms) == ("IForest", 3, 64, 0.5, 7)
    with pytest.raises(ValueError):
        DbstreamConfig(epsilon=0)
    df = spark.createDataFrame([(167772161, 1, 0.5, 1, 0)], "src_ip long, dst_ip long, score double, pred int, label int")
    at = writers.write_csv(writers.predictions(df, {"score": "Score"}), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(at).first().asDict() == {"SrcIP": "10.0.0.1", "DstIP": "0.0.0.1", "Score": "0.5", "Pred": "1", "Label": "0"}
    named = writers.plot_frame(df.withColumn("flag", F.lit(True)), {0: "benign", 1: "attack"}).first()
    assert (named.label_name, named.flag) == ("benign", 1)


def test_addresses(spark):
    rows = [("1.2.3.4", "::1"), ("1.2.3.256", "zz"), ("1.2.3", None)]
    got = spark.createDataFrame(rows, "a string, b string").select(codes.ip_number(F.col("a")), codes.ip6_number(F.col("b")), codes.ip6_text(codes.ip6_number(F.col("b")))).collect()
    assert [tuple(r) for r in got] == [(16909060, "1", "::1"), (None, None, None), (None, None, None)]


def test_a_stored_table_leaves_no_shuffle_files(spark):
    from netloom.functions.store import stored

    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {x for x in files.getAllFiles().mkString("|").split("|") if "shuffle_" in x}
    rows = spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).count().repartitionByRange(3, "k")
    before = names()
    out = stored(rows, "clean")
    for _ in range(50):  # files are deleted by another thread
        if not (left := names() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_numbers_above_32_bits_keep_their_own_dotted_form(spark):
    numbers = [65793, 255 * 16777216 + 65793, 256 * 16777216 + 65793, 900_000 * 16777216 + 65793, -1]
    n = F.col("n")
    got = spark.createDataFrame([(x,) for x in numbers], "n long").select("n", codes.dotted(n).alias("t"), codes.ip_number(codes.dotted(n), wide=True).alias("w"), codes.ip_number(codes.dotted(n)).alias("s")).collect()
    assert [r.t for r in got] == ["0.1.1.1", "255.1.1.1", "256.1.1.1", "900000.1.1.1", "255.255.255.255"]
    assert [r.w for r in got[:4]] == numbers[:4] and [r.s for r in got[:4]] == [*numbers[:2], None, None]


def test_states_in_steps_are_those_of_one_step(spark, sf_dir, monkeypatch):
    f = V.flows(spark, sf_dir, 60).limit(700)
    f = spark.createDataFrame(f.collect(), f.schema)
    want = sorted(tuple(r) for r in graph.cumulative_state(f, V.ORDER).select("ord", *graph.STATE).collect())
    monkeypatch.setattr(graph, "FLOWS_AT_A_TIME", 300)
    got = graph.cumulative_state(f, V.ORDER, graph.ENDS)
    assert got.columns == [*graph.ENDS, "ord", *graph.STATE]  # no column that nobody reads is carried
    assert sorted(tuple(r) for r in got.select("ord", *graph.STATE).collect()) == want


@pytest.mark.parametrize("octave", [1, 128])
def test_order_statistics_by_bins(spark, monkeypatch, octave):
    monkeypatch.setattr(profile, "OCTAVE", octave)
    values = [0.0, -1.5, 3.25, 3.25, 1e-310, -1e300, float("inf"), float("-inf"), 7.0, 7.5, 2.0**60, None, 0.1, 0.10000001, -0.25]
    df = spark.createDataFrame([(k, v) for k in (1, None) for v in values[: 15 if k else 6]], "k long, v double")
    places = {f"p{i}": (lambda n, i=i: F.least(F.lit(i), n)) for i in range(1, 16)}
    for r in profile.order_statistics(df, ["k"], "v", places).collect():
        line = sorted(values[: r.n], key=lambda x: (x is not None, x or 0.0))
        assert r.n == (15 if r.k else 6) and [r[f"p{i}"] for i in range(1, 16)] == [line[min(i, r.n) - 1] for i in range(1, 16)]
    plan = []
    kept = profile.ordering.bucketed
    monkeypatch.setattr(profile.ordering, "bucketed", lambda rows, order, n=None: plan.append(rows.count()) or kept(rows, order, n))
    many = spark.range(1, 20001).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    assert profile.order_statistics(many, ["k"], "v", profile.MIDDLE).first()["low"] == 10000
    assert plan[0] < 20000  # only values of the bins that hold a place are put in order


def test_mixed_stores_no_features_and_shuffles_steps_of_flows(spark, sf_dir, monkeypatch):
    """The whole table's shuffles are cut into steps; results do not change with them."""
    names, got = [], []
    for module in (graph, detectors, ordering):
        monkeypatch.setattr(module, "stored", lambda df, name, f=module.stored: (names.append(name), f(df, name))[1])
    for at_a_time in (graph.FLOWS_AT_A_TIME, 2000):
        monkeypatch.setattr(graph, "FLOWS_AT_A_TIME", at_a_time)
        names.clear()
        out = detectors.detect(M._split(spark, sf_dir), config.EngineConfig(algorithm="Mix"))
        got.append(sorted(map(tuple, out.predictions.select("flow_idx", "pid", "assignment", "label", "pred").collect())))
        assert not {"mix_features", "mix_pred", "split_flows"} & set(names)
    assert got[0] == got[1] and len(got[0]) == 6000
    assert names.count("edges") == names.count("flow_states") == 3


def test_random_forest_reads_all_rows_and_not_their_places(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 6))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0.5)).astype(int)
    df = spark.createDataFrame([(i, int(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x, strict=True))], "flow_idx long, label int, " + ", ".join(f"x{i} double" for i in range(6)))
    names = [f"x{i}" for i in range(6)]
    a, b = (learners.fit_forest(df.where("flow_idx < 3000").repartition(n), names, "flow_idx") for n in (3, 7))
    assert (a.feature == b.feature).all() and (a.split == b.split).all() and (a.votes == b.votes).all()
    assert abs(a.votes[:, 0].sum(1) - 3000).max() < 300 and (a.votes[:, 0].sum(1) != 3000).any()  # all rows, drawn with repeats
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    got = a.predict(df.where("flow_idx >= 3000")).select("label", "pred").collect()
    assert np.mean([r.label == r.pred for r in got]) > 0.85
    assert [r.pred for r in learners.fit_forest(df.where("label = 0"), names, "flow_idx").predict(df.limit(3)).collect()] == [0, 0, 0]
    with pytest.raises(ValueError, match="labels"):
        learners.fit_forest(df.limit(0), names, "flow_idx")


def test_near_pairs_of_a_crowded_cell_are_exact_and_not_joined(spark):
    """Points far from the origin, and one that overflows; a cell's pairs make no rows unless they are within epsilon."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.uniform(0, 1, (700, 3)) + [0, 0, 1e6], rng.uniform(-1, 1, (40, 3)) * 1e200])
    rows = [(i, 1, i % 3 == 0, i % 2, (0, 0), *map(float, r)) for i, r in enumerate(x)]
    placed = spark.createDataFrame(rows, "_p long, _w long, _d boolean, _g long, _c struct<_y0: long, _y1: long>, _x0 double, _x1 double, _x2 double")
    hot = placed.limit(1).selectExpr("_c", "3L AS _parts")
    got = learners._within(placed, hot, 0.1, "_d", learners._not_both)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "MapInArrow" in plan
    d2 = lambda i, j: sum((x[i, k] - x[j, k]) * (x[i, k] - x[j, k]) for k in range(3))
    with np.errstate(over="ignore"):
        want = [(i, j) for i in range(740) for j in range(i + 1, 740) if (i % 3 or j % 3) and d2(i, j) <= 0.1 * 0.1]
    assert sorted((r._p, r._q) for r in got.collect()) == want and len(want) > 100
