"""Joins of a large table to one row for each key, where a key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many keys their table is broadcast; beyond, the join is shuffled with salted keys.
MAX_BROADCAST_KEYS = 100_000
SALTS = 32


def by_key(rows: DataFrame, values: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined to ``values``, a stored table of one row for each ``key``.

    The rows of a key are dealt over SALTS tasks by a hash of the whole row, with a
    copy of the key's values for each.  Null keys match nothing."""
    if values.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS:
        return rows.join(F.broadcast(values), key, how)
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(SALTS))
    copies = values.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", salt).join(copies, [key, "_salt"], how).drop("_salt")
