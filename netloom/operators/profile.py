"""Aggregates: metrics, robust statistics, histograms, and the 24-d subgraph signature."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.store import stored
from netloom.operators import ordering
from netloom.operators.joins import MAX_BROADCAST_KEYS

EPS = 1e-12
BINS = 32

# Histogram ranges of the signature's distributions, by name: (feature expression's name, low, high).
RANGES = {"bw": (0.0, 14.0), "pps": (0.0, 14.0), "pkt": (0.0, 2000.0), "rar": (0.0, 10.0), "scn": (0.0, 1.0), "sdeg": (0.0, 14.0), "ddeg": (0.0, 14.0)}
#: The graph feature that each distribution reads.
SOURCES = {"bw": "v10", "pps": "v11", "pkt": "v12", "rar": "v19", "scn": "v18", "sdeg": "v0", "ddeg": "v2"}

SIGNATURE = [
    "log_bytes_mean", "log_packets_mean", "duration_median", "bandwidth_p50", "bandwidth_p95", "bandwidth_cv", "pps_cv", "packet_size_mean", "packet_size_cv",
    "src_out_mean", "src_out_iqr", "dst_in_mean", "dst_in_iqr", "imbalance_p95", "edge_count_mean", "density_mean", "rarity_mean", "rarity_p95",
    "scan_mean", "scan_fraction", "proto_entropy", "proto_hhi", "src_degree_entropy", "dst_degree_entropy",
]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    p, y = F.col(pred) == 1, F.col(label) == 1
    return df.agg(F.count_if(p & y).alias("tp"), F.count_if(~p & ~y).alias("tn"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))


def metrics(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1, F2 and false positive rate; 0 for an empty denominator."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = confusion(df, pred, label).select(
        "*", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("fpr")
    )
    p, r = F.col("precision"), F.col("recall")
    return out.select("*", ratio(2 * p * r, p + r).alias("f1"), ratio(5 * p * r, 4 * p + r).alias("f2"))


def unpivoted(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep, feature, value) rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns)))
    return df.select(*(keep or []), pairs.alias("_p")).select(*(keep or []), "_p.feature", "_p.value")


#: Values that are counted at a time.
COUNTED_ROWS = 50_000_000


def feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, maximum, median and mode (the lowest of several) of each feature."""
    long = unpivoted(df, columns)
    some = long.where(F.col("value").isNotNull())
    each = max(1, COUNTED_ROWS // max(1, df.count()))  # columns whose values are counted at a time, as most may be distinct
    modes = []
    for i in range(0, len(columns), each):
        part = unpivoted(df, columns[i : i + each]).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("k"))
        modes.append(stored(part.groupBy("feature").agg(F.max(F.struct("k", (-F.col("value")).alias("v"))).alias("m")), "modes"))
    counts = reduce(DataFrame.unionByName, modes)
    middle = order_statistics(some, ["feature"], "value", MIDDLE)
    out = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.max("value").alias("max")).join(middle, "feature", "left").join(counts, "feature", "left")
    return out.select("feature", "mean", "max", ((F.col("low") + F.col("high")) / 2).alias("median"), (-F.col("m.v")).alias("mode"))


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"))


def cluster_stats(df: DataFrame, cluster: str = "cluster", distance: str = "distance") -> DataFrame:
    d = F.col(distance)
    return df.groupBy(cluster).agg(F.count("*").alias("size"), F.avg(d).alias("mean"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("std"), F.min(d).alias("min"), F.max(d).alias("max"))


def ranked(df: DataFrame, keys: list[str], value: str, tie: list[str] | None = None) -> DataFrame:
    """df with _r (1, 2, ... by value within keys) and _n (rows of the keys)."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_r", F.row_number().over(w.orderBy(value, *(tie or [])))).withColumn("_n", F.count("*").over(w))


#: The two middle places of n values in order.
MIDDLE = {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor(n / 2) + 1}


def order_statistics(df: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, n, and for each of ``places``, number of rows -> place from 1, the value there in ascending order).

    Rows are counted by bins of their values, which are in order; only those of the bins
    that hold a place are counted by value.  These counts are range-partitioned by keys
    and value, so neither a key nor a value that many rows share meets in one task."""
    rows = df.select(*keys, F.col(value).alias("_v"), ordered_bin(F.col(value)).alias("_b"))
    bins = stored(rows.groupBy(*keys, "_b").agg(F.count("*").alias("_k")), "bins")
    whole = Window.partitionBy(*keys)
    lined = bins.select(*keys, "_b", "_k", F.sum("_k").over(whole.orderBy("_b")).alias("_to"), F.sum("_k").over(whole).alias("n"))
    at = [f(F.col("n")) for f in places.values()]
    holds = lambda ahead: reduce(or_, [(a > ahead) & (a <= F.col("_to")) for a in at])
    ahead = F.col("_to") - F.col("_k")
    wanted = lined.where(holds(ahead)).select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_b").alias("_of_b"), "n", ahead.alias("_ahead"))
    wanted = stored(wanted, "wanted_bins")
    few = wanted.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS
    inside = rows.join(F.broadcast(wanted) if few else wanted, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col("_b").eqNullSafe(F.col("_of_b"))])
    counts = inside.groupBy(*keys, "_b", "_ahead", "n", "_v").agg(F.count("*").alias("_k"))
    lined = ordering.running(ordering.bucketed(counts, [*keys, "_v"]), [*keys, "_b"], ["_v"], {"_sum": F.col("_k")})
    placed = lined.withColumn("_to", F.col("_ahead") + F.col("_sum"))
    placed = placed.where(holds(F.col("_to") - F.col("_k"))).groupBy(*keys, "n")
    pick = lambda a: F.max(F.when((a > F.col("_to") - F.col("_k")) & (a <= F.col("_to")), F.col("_v")))
    return placed.agg(*(pick(a).alias(name) for name, a in zip(places, at, strict=True)))


#: Bins of an octave.
OCTAVE = 128


def ordered_bin(x: Column) -> Column:
    """A bin of x, null for null: no greater value has a smaller one.  A NaN is greater than all numbers."""
    d = x.cast("double")
    size = F.when(F.abs(d) == float("inf"), F.lit(1 << 19)).otherwise(F.floor(F.log2(F.abs(d)) * OCTAVE).cast("int") + (1 << 18))  # the least exponent is -1074
    return F.when(F.isnan(d), F.lit(1 << 20)).when(d == 0, F.lit(0)).when(d > 0, size).when(d < 0, -size)


def cluster_radius(df: DataFrame, cluster: str = "cluster", distance: str = "distance", q: float = 0.995, few: int = 5, default: float = 3.0) -> DataFrame:
    """The order statistic floor(q n) of each cluster's distances, at most the last; default below ``few`` points."""
    picked = order_statistics(df, [cluster], distance, {"at": lambda n: F.least(F.floor(F.lit(q) * n), n - 1) + 1})
    return picked.select(cluster, F.when(F.col("n") < few, F.lit(default)).otherwise(F.col("at")).alias("radius"))


def lower_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """The order statistic floor(q (n - 1)) within keys."""
    return order_statistics(df, keys, value, {name: lower_place(q)}).select(*keys, name)


def lower_place(q: float) -> Callable[[Column], Column]:
    return lambda n: F.floor(F.lit(q) * (n - 1)) + 1


def quantile_at(sorted_values: Column, q: float) -> Column:
    """The lower quantile of a sorted array."""
    return F.element_at(sorted_values, (F.floor(F.lit(q) * (F.size(sorted_values) - 1)) + 1).cast("int"))


def robust_stats(df: DataFrame, keys: list[str], value: str, threshold: float) -> DataFrame:
    """q25, q50, q75, q95 (lower), iqr, mean, cv and the fraction of values of threshold or more.

    Quantiles read exact order statistics from ranks, not from collected lists."""
    qs = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    v = F.col(value)
    picks = order_statistics(df, keys, value, {n: lower_place(q) for n, q in qs.items()})
    means = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("_sd"), F.avg((v >= threshold).cast("double")).alias("fraction"))
    out = picks.join(means.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "mean", "_sd", "fraction"), [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    iqr = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("q75") - F.col("q25")))
    return out.select(*keys, "n", *qs, iqr.alias("iqr"), "mean", cv(F.col("n"), F.col("mean"), F.col("_sd")).alias("cv"), "fraction")


def cv(n: Column, mean: Column, sd: Column) -> Column:
    return F.when((n < 2) | (mean == 0), F.lit(0.0)).otherwise(sd / F.greatest(F.lit(EPS), F.abs(mean)))


def bin_of(x: Column, lo: float, hi: float, bins: int = BINS) -> Column:
    """The bin of a value clamped to [lo, hi]."""
    clamped = F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    return F.least(F.lit(bins - 1), F.floor((clamped - lo) / (hi - lo) * bins).cast("int"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def histogram(df: DataFrame, keys: list[str], value: str, lo: float, hi: float, bins: int = BINS) -> DataFrame:
    """(keys, bin, n) of finite values; empty bins have no row."""
    return df.where(finite(F.col(value))).groupBy(*keys, bin_of(F.col(value), lo, hi, bins).alias("bin")).agg(F.count("*").alias("n"))


def pdf(hist: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """(keys, bin, p) for every bin: (n + eps) / sum, the counts' shares smoothed."""
    wide = hist.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("total"))
    dense = wide.select(*keys, "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "m")
    share = F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)) / F.col("total")
    return dense.select(*keys, "bin", ((share + EPS) / (1 + bins * EPS)).alias("p"))


def protocol_pdf(df: DataFrame, keys: list[str], proto: str = "proto") -> DataFrame:
    """(keys, bin, p) for every protocol from 0 to the largest one of the keys."""
    counts = df.groupBy(*keys, F.col(proto).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    wide = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("total"), F.max("bin").alias("top"))
    dense = wide.select(*keys, "total", "top", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("bin"), "m")
    share = F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)) / F.col("total")
    return dense.select(*keys, "bin", ((share + EPS) / (1 + (F.col("top") + 1) * EPS)).alias("p"))


def entropy_hhi(p: DataFrame, keys: list[str]) -> DataFrame:
    """Shannon entropy (nats, smoothed once more) and Herfindahl index of (keys, bin, p)."""
    q = (F.col("p") + EPS) / (F.sum("p").over(Window.partitionBy(*keys)) + F.count("*").over(Window.partitionBy(*keys)) * EPS)
    return p.withColumn("q", q).groupBy(*keys).agg((-F.sum(F.col("q") * F.log("q"))).alias("entropy"), F.sum(F.col("p") * F.col("p")).alias("hhi"))


def median_mad(df: DataFrame, value: str) -> DataFrame:
    """One row: median and 1.4826 times the median absolute deviation."""
    some = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_x"))
    middle = lambda rows: order_statistics(rows, [], "_x", MIDDLE).select(((F.col("low") + F.col("high")) / 2).alias("median"))
    med = middle(some)
    off = some.join(F.broadcast(med)).select(F.abs(F.col("_x") - F.col("median")).alias("_x"))  # med is one row
    return med.join(F.broadcast(middle(off).select((1.4826 * F.col("median")).alias("mad"))))


def distributions(features: DataFrame) -> DataFrame:
    """(pid, dist, bin, p) of the eight distributions of each partition."""
    values = F.explode(F.array(*(F.struct(F.lit(d).alias("dist"), F.col(v).alias("x"), F.lit(RANGES[d][0]).alias("lo"), F.lit(RANGES[d][1]).alias("hi")) for d, v in SOURCES.items())))
    long = features.select("pid", values.alias("_d")).select("pid", "_d.*").where(finite(F.col("x")))
    clamped = F.greatest(F.col("lo"), F.least(F.col("hi"), F.col("x")))
    b = F.least(F.lit(BINS - 1), F.floor((clamped - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).cast("int"))
    hist = long.groupBy("pid", "dist", b.alias("bin")).agg(F.count("*").alias("n"))
    proto = protocol_pdf(features, ["pid"], "v13").select("pid", F.lit("proto").alias("dist"), "bin", "p")
    return pdf(hist, ["pid", "dist"]).unionByName(proto)


#: Values whose order statistics the signature reads.
_RANKED = {"bw": "v10", "pps": "v11", "pkt": "v12", "dur": "greatest(0D, exp(v9) - 1)", "so": "v0", "di": "v2", "imb": "0.5D * (v4 + v5)", "rar": "v19"}


def signature(features: DataFrame) -> DataFrame:
    """pid, n and the 24 values of each partition; what is not finite counts 0.

    Order statistics come from ranks within (pid, value's name); nothing is collected."""
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.expr(e).alias("value")) for n, e in _RANKED.items())))
    stats = robust_stats(features.select("pid", named.alias("_x")).select("pid", "_x.*"), ["pid", "feature"], "value", 0.8)
    of = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))
    picked = stats.groupBy("pid").agg(
        of("dur", "q50").alias("duration_median"), of("bw", "q50").alias("bandwidth_p50"), of("bw", "q95").alias("bandwidth_p95"), of("bw", "cv").alias("bandwidth_cv"),
        of("pps", "cv").alias("pps_cv"), of("pkt", "mean").alias("packet_size_mean"), of("pkt", "cv").alias("packet_size_cv"), of("so", "mean").alias("src_out_mean"),
        of("so", "iqr").alias("src_out_iqr"), of("di", "mean").alias("dst_in_mean"), of("di", "iqr").alias("dst_in_iqr"), of("imb", "q95").alias("imbalance_p95"),
        of("rar", "mean").alias("rarity_mean"), of("rar", "q95").alias("rarity_p95"),
    )
    means = features.groupBy("pid").agg(
        F.count("*").alias("n"), F.avg("v7").alias("log_bytes_mean"), F.avg("v8").alias("log_packets_mean"), F.avg("v6").alias("edge_count_mean"), F.avg("v16").alias("density_mean"),
        F.avg("v18").alias("scan_mean"), F.avg((F.col("v18") >= 0.8).cast("double")).alias("scan_fraction"),
    )
    spread = entropy_hhi(distributions(features).where(F.col("dist").isin("proto", "sdeg", "ddeg")), ["pid", "dist"])
    e = lambda d, c: F.max(F.when(F.col("dist") == d, F.col(c)))
    spread = spread.groupBy("pid").agg(e("proto", "entropy").alias("proto_entropy"), e("proto", "hhi").alias("proto_hhi"), e("sdeg", "entropy").alias("src_degree_entropy"), e("ddeg", "entropy").alias("dst_degree_entropy"))
    out = means.join(picked, "pid").join(spread, "pid")
    return out.select("pid", "n", *(F.when(finite(F.col(c)), F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in SIGNATURE))


def loosest_cluster(df: DataFrame, cluster: str = "cluster", distance: str = "distance") -> DataFrame:
    """The cluster of the largest mean distance, the smallest id of several."""
    return df.groupBy(cluster).agg(F.avg(distance).alias("mean")).orderBy(F.desc("mean"), cluster).limit(1)


def farthest_points(df: DataFrame, cluster: str = "cluster", distance: str = "distance", idx: str = "idx") -> DataFrame:
    """The farthest point of each cluster, the smallest index of several."""
    best = F.max(F.struct(F.col(distance).alias("d"), (-F.col(idx)).alias("i")))
    return df.groupBy(cluster).agg(best.alias("_b")).select(cluster, (-F.col("_b.i")).alias(idx), F.col("_b.d").alias(distance))


def majority(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("n")).orderBy(F.desc("n"), cluster).limit(1)
