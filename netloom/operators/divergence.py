"""Divergences between distributions, partition scores and the selection of suspicious partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.profile import EPS, ranked


def _smoothed(p: Column) -> Column:
    """An array plus eps, over its sum."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x + EPS)
    return F.transform(p, lambda x: (x + EPS) / total)


def _kl(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: a * F.log(a / b)), F.lit(0.0), lambda s, x: s + x)


def padded(p: Column, q: Column) -> Column:
    """p with zeros up to q's length."""
    return F.concat(p, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.size(q) - F.size(p))))


def kl(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence; the shorter side is padded with zeros, both smoothed; not below 0."""
    return F.greatest(F.lit(0.0), _kl(_smoothed(padded(p, q)), _smoothed(padded(q, p))))


def _js(a: Column, b: Column) -> Column:
    m = F.zip_with(a, b, lambda x, y: 0.5 * (x + y))
    return F.greatest(F.lit(0.0), 0.5 * _kl(a, m) + 0.5 * _kl(b, m))


def js(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence, padded."""
    return _js(_smoothed(padded(p, q)), _smoothed(padded(q, p)))


def js_distance(p: Column, q: Column) -> Column:
    return F.sqrt(js(p, q))


def js_truncated(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence over the bins that both have; 0 without any."""
    n = F.least(F.size(p), F.size(q))
    a, b = _smoothed(F.slice(p, 1, F.greatest(n, F.lit(1)))), _smoothed(F.slice(q, 1, F.greatest(n, F.lit(1))))
    return F.when(n < 1, F.lit(0.0)).otherwise(_js(a, b))


def dense(distributions: DataFrame) -> DataFrame:
    """(pid, dist, p: array by bin) of long (pid, dist, bin, p)."""
    rows = F.array_sort(F.collect_list(F.struct("bin", "p")))  # at most as many as bins
    return distributions.groupBy("pid", "dist").agg(F.transform(rows, lambda x: x["p"]).alias("p"))


def pairwise(arrays: DataFrame) -> DataFrame:
    """(a, b, js): the mean over distributions of the divergence of every two
    partitions.  Partitions are a bounded set (the partitioner's number), so the
    join holds partitions squared rows, whatever the flows."""
    p = arrays.select(F.col("pid").alias("a"), "dist", F.col("p").alias("pa"))
    q = arrays.select(F.col("pid").alias("b"), "dist", F.col("p").alias("pb"))
    half = p.join(q, "dist").where("a < b").groupBy("a", "b").agg(F.avg(js_truncated(F.col("pa"), F.col("pb"))).alias("js"))
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.select(both.alias("_x"), "js").select("_x.a", "_x.b", "js")


def partition_scores(arrays: DataFrame) -> DataFrame:
    """(pid, score): the lower median of a partition's divergences from the others; 0 if it is alone."""
    at = F.floor(0.5 * (F.col("_n") - 1)) + 1
    score = ranked(pairwise(arrays), ["a"], "js", ["b"]).where(F.col("_r") == at).select(F.col("a").alias("pid"), F.col("js").alias("score"))
    return arrays.select("pid").distinct().join(score, "pid", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def threshold(scores: DataFrame, factor: float = 2.5, q: float = 0.95) -> DataFrame:
    """One row: n, median, mad, q95 and tau = max(median + factor * mad, q95)."""
    med = scores.agg(F.expr("percentile(score, 0.5)").alias("median"), F.count("*").alias("n"))
    mad = scores.join(med).groupBy("median", "n").agg((1.4826 * F.expr("percentile(abs(score - median), 0.5)")).alias("mad"))
    at = F.floor(F.lit(q) * (F.col("_n") - 1)) + 1
    q95 = scores.withColumn("_r", F.row_number().over(Window.orderBy("score", "pid"))).withColumn("_n", F.count("*").over(Window.partitionBy())).where(F.col("_r") == at).select(F.col("score").alias("q95"))
    return mad.join(q95).withColumn("tau", F.greatest(F.col("median") + factor * F.col("mad"), F.col("q95")))


def selection(scores: DataFrame) -> DataFrame:
    """(pid, score, place, tau, selected): partitions of tau or more, at least
    max(5, n / 100) of the highest, at most max(1, floor(n / 10)) unless under five were found.

    Scores are one row for each partition, a bounded set, so one window holds them."""
    t = threshold(scores)
    lined = scores.join(F.broadcast(t)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "pid")).cast("long"))
    lined = lined.withColumn("above", F.sum((F.col("score") >= F.col("tau")).cast("int")).over(Window.partitionBy()))
    least, most = F.greatest(F.lit(5), F.floor(F.col("n") / 100)), F.greatest(F.lit(1), F.floor(F.col("n") * 0.1))
    size = F.when(F.col("above") < least, F.least(least, F.col("n"))).when(F.col("above") > most, most).otherwise(F.col("above"))
    return lined.select("pid", "score", "place", "tau", (F.col("place") <= size).alias("selected"))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(x: Column, y: Column) -> Column:
    n = norm(x) * norm(y)
    return F.when(n > 0, dot(x, y) / n).otherwise(F.lit(0.0))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v))
