"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate rates and L1 leave a few thousand weights, which are broadcast.
Words are lower-cased (A-Z) and lose punctuation at their ends.

Cases: a null text scores as the empty one, by the bias alone; ids that are null
or not labelled are scored like any other; ids labelled twice count as toxic if
any row says so; repeated rows get equal scores; an empty table gives an empty
result; without labelled rows every score is 0.5.  Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm import linear

FEATURES = linear.Features(bits=20, orders=(1, 2), skips=(2,), lower=True, trim=True)
#: At most so many labelled documents train the model.
TRAIN_ROWS = 8_000
EPOCHS = 5
RATES = {"alpha": 1.0, "beta": 1.0, "l1": 8.0, "l2": 0.1}


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, bound: int = TRAIN_ROWS) -> linear.Model:
    rows = linear.labelled(docs, labels, "toxic", learn, bound)
    return linear.trained(linear.examples(rows, FEATURES), FEATURES, EPOCHS, **RATES)


def score(docs: DataFrame, model: linear.Model, name: str = "score") -> DataFrame:
    return linear.with_score(docs, model, name)


def reject(docs: DataFrame, model: linear.Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, columns as they were."""
    from netloom.llm.mixing import fresh

    name = fresh(docs, "toxicity")
    return score(docs, model, name).where(F.col(name) < threshold).drop(name)


def report(docs: DataFrame, labels: DataFrame, fold: int = 5, bound: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; ids whose crc32 leaves 0 modulo fold are held out of learning."""
    model = fit(docs, labels, remainder(F.col("doc_id"), fold) != 0, bound)
    out = score(docs.select("doc_id", "text"), model).select("doc_id", "score")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), fold) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
