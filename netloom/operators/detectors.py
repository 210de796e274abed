"""Detector pipelines: flows with features to predictions and metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.config import EngineConfig
from netloom.functions import codes
from netloom.functions.store import stored
from netloom.operators import divergence, graph, learners, profile, scaling
from netloom.operators.flows import flow_vector

BASIC = ["f_sport", "f_dport", "f_proto", "f_duration", "f_packets", "f_bytes_per_packet"]
KEEP = ["flow_idx", "src_ip", "dst_ip", "label", "is_train"]
ORDER = ["ts_start", "flow_idx"]


@dataclass
class Result:
    """predictions: KEEP with pred; metrics: one row; tables: further results by name."""

    predictions: DataFrame | None
    metrics: DataFrame | None
    tables: dict[str, DataFrame]


def _state(flows: DataFrame, cfg: EngineConfig) -> DataFrame:
    return graph.state(flows, ORDER, cfg.graph.mode, cfg.graph.ttl_ms, cfg.graph.prune_interval_ms)


def featured(flows: DataFrame, cfg: EngineConfig) -> DataFrame:
    """All flows with the 20 features, computed over stored states; test_graph "empty" gives test flows a graph that saw nothing."""
    if cfg.graph.test_graph == "empty":
        test = graph.empty_state(flows.where("NOT is_train"), ORDER)
        states = _state(flows.where("is_train"), cfg).unionByName(test)
    else:
        states = _state(flows, cfg)
    return states.select(*flows.columns, *graph.feature_columns())


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("is_train"), df.where("NOT is_train")


def _result(pred: DataFrame, **tables: DataFrame) -> Result:
    return Result(pred, profile.metrics(pred), tables)


def analyze(flows: DataFrame, cfg: EngineConfig) -> Result:
    """Statistics of the features, rounded to 6 places (a mode should not hang on last bits), and their plane."""
    f = featured(flows, cfg)
    scaled = scaling.fit_scaler(f, graph.FEATURES).transform(f)
    return Result(None, None, {"stats": profile.feature_stats(f.select(*(F.round(c, 6).alias(c) for c in graph.FEATURES)), graph.FEATURES), "pca": scaling.pca_2d(scaled, graph.FEATURES, ["label"])})


def random_forest(flows: DataFrame, cfg: EngineConfig) -> Result:
    """Both sets of features are computed from the stored states, so that nothing is joined to them."""
    columns = BASIC + graph.FEATURES
    train, test = _split(flow_vector(featured(flows, cfg), [*KEEP, *graph.FEATURES]))
    model = learners.fit_forest(train, columns, "flow_idx", seed=cfg.iforest.random_seed)
    return _result(model.predict(test).select(*KEEP, "pred"))


def mini_batch_kmeans(flows: DataFrame, cfg: EngineConfig) -> Result:
    benign = flows.where("label = 0 OR NOT is_train")
    f = featured(benign, cfg)
    columns = BASIC + graph.FEATURES
    f = stored(flow_vector(f, f.columns), "kmeans_features")
    train, _ = _split(f)
    scaler = scaling.fit_scaler(train, columns)
    scaled = scaler.transform(f)
    model = learners.fit_kmeans(scaled.where("is_train"), columns, cfg.kmeans, "flow_idx")
    placed = stored(model.assign(scaled).select(*KEEP, "cluster", "distance"), "kmeans_placed")
    train, test = _split(placed)
    radius = profile.cluster_radius(train)
    pred = test.join(F.broadcast(radius), "cluster", "left")  # at most k rows
    pred = pred.withColumn("pred", F.coalesce((F.col("distance") > F.col("radius")).cast("int"), F.lit(0)))
    return _result(pred.select(*KEEP, "cluster", "distance", "pred"), stats=profile.cluster_stats(train), train=train, test=test, radius=radius)


def isolation_forest(flows: DataFrame, cfg: EngineConfig) -> Result:
    """The scaler and the forest are fit on benign training flows; the same graph goes on through the test flows."""
    f = featured(flows.where("label = 0 OR NOT is_train"), cfg)
    train, test = _split(f)
    scaler = scaling.fit_scaler(train, graph.FEATURES)
    forest = learners.fit_iforest(scaler.transform(train), graph.FEATURES, cfg.iforest, "flow_idx")
    scored = stored(forest.score(scaler.transform(test)), "forest_scored")
    pred = scored.withColumn("pred", (F.col("score") > cfg.iforest.outline_threshold).cast("int"))
    return _result(pred.select(*KEEP, "score", "pred"), pca=scaling.pca_2d(pred, graph.FEATURES, ["pred", "label"]))


def cluster_outliers(df: DataFrame) -> DataFrame:
    """df (idx, cluster, distance) with pred: the farthest point of each cluster
    and all points of the one of the largest mean distance; noise is normal."""
    members = df.where("cluster IS NOT NULL")
    far = profile.farthest_points(members).select("idx")
    loose = profile.loosest_cluster(members).select("cluster")
    marked = far.union(members.join(loose, "cluster", "left_semi").select("idx")).distinct().withColumn("pred", F.lit(1))
    return df.join(marked, "idx", "left").withColumn("pred", F.coalesce("pred", F.lit(0)))


def centroid_distances(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the distance to its cluster's centroid, -1 for noise."""
    means = df.where("cluster IS NOT NULL").groupBy("cluster").agg(*(F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)))
    parts = [(F.col(c) - F.col(f"_m{i}")) * (F.col(c) - F.col(f"_m{i}")) for i, c in enumerate(columns)]
    d = F.sqrt(sum(parts[1:], parts[0]))
    return df.join(means, "cluster", "left").select(*df.columns, F.coalesce(d, F.lit(-1.0)).alias("distance"))


def density(flows: DataFrame, cfg: EngineConfig) -> Result:
    f = featured(flows, cfg)
    scaled = scaling.fit_scaler(f, graph.FEATURES).transform(f).withColumn("idx", F.col("flow_idx"))
    placed = learners.dbscan(scaled, graph.FEATURES, cfg.dbscan.epsilon, cfg.dbscan.min_points)
    out = stored(cluster_outliers(centroid_distances(placed, graph.FEATURES)), "dbscan_out")
    return _result(out.select(*KEEP, "cluster", "distance", "pred"), pca=scaling.pca_2d(out, graph.FEATURES, ["cluster", "label", "pred"]), stats=profile.feature_stats(f, graph.FEATURES))


#: Bits of each partition's Bloom filter.
BLOOM_BITS = 1 << 18


def mixed(flows: DataFrame, cfg: EngineConfig) -> Result:
    """Partitions, their signatures and scores; the suspicious ones are clustered
    as streams.  Each partition has a graph of its own."""
    n = cfg.partitions
    if cfg.partitioning == "hashed":
        parts = learners.hashed_partitions(flows, n)
    else:
        parts = learners.greedy_partitions(flows, n, bits=BLOOM_BITS if cfg.partitioning == "bloom" else None)
    ends = {c: F.concat_ws(":", F.col("pid").cast("string"), F.col(c).cast("string")) for c in ("src_ip", "dst_ip")}  # nodes of different partitions are different nodes
    columns = [*dict.fromkeys([*KEEP, "pid", *graph.READ])]
    own = parts.select(*columns).withColumns({f"_{c}": F.col(c) for c in ends} | ends)
    state = graph.state(own, ORDER, cfg.graph.mode, cfg.graph.ttl_ms, cfg.graph.prune_interval_ms)
    # the features are computed from the stored states whenever they are read
    f = state.withColumns({c: F.col(f"_{c}") for c in ends}).select(*columns, *graph.feature_columns())
    arrays = stored(divergence.dense(profile.distributions(f)), "mix_distributions")
    chosen = stored(divergence.selection(divergence.partition_scores(arrays)), "mix_selection")
    suspicious = F.broadcast(chosen.where("selected").select("pid"))  # at most as many rows as partitions
    picked = f.join(suspicious, "pid", "left_semi")
    clustered = learners.dbstream_partitions(picked.withColumn("t", codes.micros(F.col("ts_start")) / 1e6), graph.FEATURES, cfg.dbstream)
    clustered = stored(clustered, "mix_clustered")
    found = picked.select(*KEEP, "pid").join(clustered.select("flow_idx", "assignment", F.coalesce(F.col("is_outlier").cast("int"), F.lit(0)).alias("pred")), "flow_idx")
    others = f.join(suspicious, "pid", "left_anti").select(*KEEP, "pid", F.lit(None).cast("int").alias("assignment"), F.lit(0).alias("pred"))
    pred = found.select(*KEEP, "pid", "assignment", "pred").unionByName(others)
    pca = clustered.join(picked.select("flow_idx", "label"), "flow_idx").select("pid", "x", "y", F.col("assignment").alias("assignments"), "label", F.col("is_outlier").cast("int").alias("is_outlier"))
    return _result(pred, selection=chosen, signature=profile.signature(f), pca=pca)


DETECTORS: dict[str, Callable[[DataFrame, EngineConfig], Result]] = {
    "Analyze": analyze, "RF": random_forest, "DBSCAN": density, "Mini_Batch_KMeans": mini_batch_kmeans, "IForest": isolation_forest, "Mix": mixed,
}


def detect(flows: DataFrame, cfg: EngineConfig) -> Result:
    """flows: records with flow_idx and is_train."""
    if cfg.algorithm not in DETECTORS:
        raise ValueError(f"unknown algorithm {cfg.algorithm}")
    return DETECTORS[cfg.algorithm](flows, cfg)
