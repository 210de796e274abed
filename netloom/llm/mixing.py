"""Mixing sources to target weights, in DataFrame operations only.

Sizes are aggregated per source, targets follow from the weights, and each
document is emitted ``floor(rate)`` times plus one hash-seeded Bernoulli copy
with probability equal to the rate's fraction, where rate = target / size of
the source.

Cases: a null text counts 0 words; a null source is a source of its own, last
in the order; a source without words gets target 0 and rate 0; repeated rows
draw the same copy (the draw depends on seed and id alone); a null id draws by
its text; an empty table gives an empty result.  Input columns are kept
by ``mix`` whatever their names: helper columns live in one struct that is
renamed away from clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.store import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources their table is broadcast; beyond, the join is shuffled with salted keys.
MAX_BROADCAST_SOURCES = 100_000
SALTS = 64
#: Repetitions of no source go beyond this.
MAX_RATE = 3


def fresh(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, weight) -> with target: the sizes' total shared by
    weight, no target above max_rate times its source's size, the excess
    reshared by weight among the others until none is above.

    That is the level L with sum(min(max_rate * size, L * weight)) = total.
    Sources in order of cap / weight are capped up to the first one whose cap
    holds the level reached by those from it on.
    """
    cap = F.col("source_size") * max_rate
    order = Window.orderBy((cap / F.col("weight")).asc(), "weight", "source_size", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = (
        sizes.withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("capped")).cast("double") / (F.col("weights") - F.col("used")).cast("double"))
    )
    holds = F.col("cap").cast("double") >= F.col("level") * F.col("weight")
    first = F.min(F.when(holds, F.struct(F.col("used"), F.col("level")))).over(everything)["level"]
    return t.withColumn("target", F.least(F.col("cap").cast("double"), first * F.col("weight"))).select("source", "source_size", "weight", "target")


def cyclic_weights(sizes: DataFrame, weights: list[int]) -> DataFrame:
    """Adds weight: the given ones in turn to the sources by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone; without an id, on the text."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.concat(F.lit("?"), F.md5(F.coalesce(text, F.lit("")))))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def copies_per_document(docs: DataFrame, weights: list[int], seed: str, keep: list[str] | None = None) -> DataFrame:
    """Adds the struct column given by ``mix_column``: size, source_size, target, rate, copies."""
    box = fresh(docs, "mix")
    keep = docs.columns if keep is None else keep
    src, n = F.col("source"), F.col(f"{box}.size")
    sized = docs.select(*[F.col(f"`{c}`") for c in keep], F.struct(word_count(F.col("text")).alias("size"), src.alias("source"), draw(F.col("doc_id"), F.col("text"), seed).alias("draw")).alias(box))
    by_source = docs.select("source", word_count(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    targets = stored(source_targets(cyclic_weights(by_source, weights)), "mix_targets")
    t = targets.select(F.struct("source", "source_size", "target").alias(box + "t"))
    theirs = F.col(f"{box}t.source")
    if targets.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(t), F.col(f"{box}.source").eqNullSafe(theirs), "left")
    else:
        salt = F.pmod(F.xxhash64(F.col(f"{box}.draw"), F.col("doc_id")), F.lit(SALTS))
        joined = sized.withColumn(box + "s", salt).join(
            t.withColumn(box + "u", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))),
            F.col(f"{box}.source").eqNullSafe(theirs) & (F.col(box + "s") == F.col(box + "u")), "left",
        )
    size, target = F.col(f"{box}t.source_size"), F.col(f"{box}t.target")
    rate = F.when(size > 0, target / size).otherwise(F.lit(0.0))
    extra = (F.col(f"{box}.draw") < rate - F.floor(rate)).cast("long")
    return joined.select(
        *[F.col(f"`{c}`") for c in keep],
        F.struct(n.alias("size"), size.alias("source_size"), target.alias("target"), rate.alias("rate"), (F.floor(rate) + extra).alias("copies")).alias(box),
    )


def mix(docs: DataFrame, weights: list[int], seed: str = "mix-1") -> DataFrame:
    """The mixed corpus: docs' columns, each row as often as the mix takes it."""
    box = fresh(docs, "mix")
    out = copies_per_document(docs, weights, seed)
    return out.withColumn(box, F.explode(F.array_repeat(F.lit(0), F.col(f"{box}.copies").cast("int")))).drop(box)


def mix_report(docs: DataFrame, weights: list[int], seed: str = "mix-1") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, rate."""
    m = copies_per_document(docs.select("doc_id", "source", "text"), weights, seed, ["doc_id"])
    return m.select(
        "doc_id", F.col("mix.size").alias("size"), F.col("mix.source_size").alias("source_size"), F.col("mix.target").alias("target"),
        (F.col("mix.size") * F.col("mix.copies")).alias("taken"), F.col("mix.copies").alias("copies"), F.col("mix.rate").alias("rate"),
    )


def mix_sql(weights: list[int], seed: str = "mix-1", max_rate: int = MAX_RATE) -> str:
    """mix_report in DuckDB SQL."""
    picks = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return rf"""
WITH d AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} {picks} END AS BIGINT) AS weight FROM s
), l AS (
  SELECT *, {max_rate} * source_size AS cap,
    CAST(sum(source_size) OVER () - coalesce(sum({max_rate} * source_size) OVER before, 0) AS DOUBLE)
      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level,
    coalesce(sum(weight) OVER before, 0) AS used
  FROM w WINDOW before AS (ORDER BY {max_rate} * source_size / weight, weight, source_size, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT level FROM l WHERE CAST(cap AS DOUBLE) >= level * weight ORDER BY used, level LIMIT 1
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM f) * weight) AS target FROM l
), r AS (
  SELECT doc_id, text, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(floor(rate) AS BIGINT) + CAST(CAST(CAST('0x' || substr(md5('{seed}' || coalesce(CAST(doc_id AS VARCHAR), '?' || md5(coalesce(text, '')))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 < rate - floor(rate) AS BIGINT) AS copies FROM r
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies, rate FROM c"""
