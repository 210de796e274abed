"""Quality classifier: hashed word n-gram logistic regression by FTRL updates, scored as sparse dot products.

Cases: as for toxicity; a null text scores as the empty one, repeated rows
score alike, an empty table gives an empty result, and without labelled rows
every score is 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm import linear
from netloom.llm.toxicity import remainder

FEATURES = linear.Features(bits=20, orders=(1, 2, 4), repeats=True)
#: At most so many labelled documents train the model.
TRAIN_ROWS = 8_000
EPOCHS = 3
RATES = {"alpha": 1.0, "beta": 1.0, "l1": 1.0, "l2": 0.1}


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, bound: int = TRAIN_ROWS) -> linear.Model:
    rows = linear.labelled(docs, labels, "quality", learn, bound)
    return linear.trained(linear.examples(rows, FEATURES), FEATURES, EPOCHS, **RATES)


def score(docs: DataFrame, model: linear.Model, name: str = "score") -> DataFrame:
    return linear.with_score(docs, model, name)


def report(docs: DataFrame, labels: DataFrame, fold: int = 3, bound: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; ids whose crc32 leaves 1 modulo fold are held out of learning."""
    model = fit(docs, labels, remainder(F.col("doc_id"), fold) != 1, bound)
    out = score(docs.select("doc_id", "text"), model).select("doc_id", "score")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), fold) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
