"""Global order and prefix sums without a single-partition window.

Rows are range-partitioned by a unique order and written once with their bucket;
a bucket's own running sums get an offset, the sum of the buckets before it.
For sums within a key, the same holds for (key, bucket), so a key with a third
of all rows is spread over all buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.store import stored

BUCKET = "_bucket"


def bucketed(df: DataFrame, order: list[str], n: int | None = None) -> DataFrame:
    """df with _bucket: rows of a higher bucket come later in the order."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *order).withColumn(BUCKET, F.spark_partition_id()), "ordered")


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], peers: bool = False, top: bool = False, before: bool = False) -> DataFrame:
    """df (bucketed) with running sums, or given ``top`` maxima, up to each row within keys.

    peers: rows of equal order count together, and stand in one bucket.  before:
    without the row itself; the first row's maximum is null.  Without keys, the
    offsets are one row for each bucket."""
    take = F.max if top else F.sum
    own = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    last = -1 if before else Window.currentRow
    frame = own.rangeBetween(Window.unboundedPreceding, last) if peers else own.rowsBetween(Window.unboundedPreceding, last)
    part = df.groupBy(*keys, BUCKET).agg(*(take(c).alias(f"_part_{n}") for n, c in values.items()))
    ahead = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col(BUCKET).alias("_key_bucket"), *(take(f"_part_{n}").over(ahead).alias(f"_off_{n}") for n in values))
    on = [F.col(f"_key_{k}").eqNullSafe(F.col(k)) for k in keys] + [F.col("_key_bucket") == F.col(BUCKET)]
    local = df.select("*", *(take(c).over(frame).alias(f"_own_{n}") for n, c in values.items()))
    part = part.where(F.coalesce(*(F.col(f"_off_{n}") for n in values)).isNotNull())  # the others have nothing ahead of them
    joined = local.join(part if keys else F.broadcast(part), on, "left")  # without keys: one row for each bucket
    whole = lambda n: F.greatest(F.col(f"_own_{n}"), F.col(f"_off_{n}")) if top else F.coalesce(f"_own_{n}", F.lit(0)) + F.coalesce(f"_off_{n}", F.lit(0))
    return joined.select(*df.columns, *(whole(n).alias(n) for n in values))


def indexed(df: DataFrame, order: list[str], name: str, n: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """df (bucketed; of its columns those of ``keep``, by default all) with name: 1, 2, ... in the order, which must be total.

    A row's place in its bucket is written with it, so that nothing is shuffled again."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # what it has above is the partition
    lined = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*(keep or df.columns), F.spark_partition_id().alias(BUCKET), place.alias("_place"))
    cut = stored(lined, "ordered")
    ahead = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(BUCKET).agg(F.count("*").alias("_size")).select(F.col(BUCKET).alias("_of_bucket"), F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_ahead"))
    out = cut.join(F.broadcast(sizes), F.col(BUCKET) == F.col("_of_bucket"))  # one row for each bucket
    out = out.select(*(keep or df.columns), BUCKET, (F.col("_place") + F.col("_ahead") + 1).alias(name))
    out.stored_at = cut.stored_at
    return out
