"""Hashed n-gram logistic regression: features, FTRL-proximal training, sparse scoring.

A document's features are the distinct hashes of its word n-grams (and
skip-grams), each a coordinate of a space of 2**bits weights.  Training reads a
bounded sample of labelled rows; scoring streams every document in Arrow
batches against the non-zero weights, which L1 keeps few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from netloom.llm import textops as T

#: Tasks that make the features of a sample, and the bytes of features that the driver holds at most.
SAMPLE_TASKS = 16
TRAIN_BYTES = 100_000_000


@dataclass(frozen=True)
class Features:
    """Which n-grams count. skips: (i, j) pairs of a word and the one j - i later."""

    bits: int = 20
    orders: tuple[int, ...] = (1, 2)
    skips: tuple[int, ...] = ()
    lower: bool = False
    trim: bool = False
    repeats: bool = False  # n-grams of one repeated word share a coordinate for each order

    def of(self, c: T.Chunk, w: T.Words | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(document, coordinate) of every n-gram of a chunk, repeats included."""
        w = w or T.words(c, lower=self.lower, trim=self.trim)
        left, docs, coords = w.left(), [], []
        keep = np.uint64((1 << self.bits) - 1)
        for k in self.orders:
            g = w.hash if k == 1 else T.grams(w.hash, k)
            inside = left[: len(g)] >= k
            at = g[inside] & keep
            if self.repeats and k > 1:
                at[self._same(w.hash, k)[inside]] = np.uint64(k)
            docs.append(w.doc[: len(g)][inside])
            coords.append(at.astype(np.int32))
        for gap in self.skips:
            n = max(0, len(w) - gap)
            inside = left[:n] > gap
            g = T.mix(w.hash[:n] * np.uint64(2 * gap + 1) + w.hash[gap:])
            docs.append(w.doc[:n][inside])
            coords.append((g[inside] & keep).astype(np.int32))
        return np.concatenate(docs), np.concatenate(coords)


    @staticmethod
    def _same(h: np.ndarray, k: int) -> np.ndarray:
        n = max(0, len(h) - k + 1)
        out = np.ones(n, bool)
        for i in range(1, k):
            out &= h[:n] == h[i : n + i]
        return out


@dataclass
class Ftrl:
    """FTRL-proximal: per-coordinate rates, L1 and L2."""

    size: int
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z, self.n = np.zeros(self.size + 1), np.zeros(self.size + 1)  # the last coordinate is the bias

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(z.shape, self.l1)
        if isinstance(at, slice):
            l1[-1] = 0
        else:
            l1[at == self.size] = 0
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (sigmoid(float(w @ value)) - y) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class Model:
    """Non-zero weights; a and b calibrate: p = sigmoid(a * logit + b)."""

    features: Features
    at: np.ndarray
    weight: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.features.bits, np.float32)
        w[self.at] = self.weight
        return w

    def logits(self, c: T.Chunk, dense: np.ndarray, w: T.Words | None = None) -> np.ndarray:
        """The sparse dot product of each document of a chunk."""
        doc, at = self.features.of(c, w)
        some = dense[at] != 0
        pair = np.unique(doc[some].astype(np.int64) << np.int64(self.features.bits) | at[some])
        return self.bias + np.bincount(pair >> self.features.bits, dense[pair & ((1 << self.features.bits) - 1)], minlength=c.n)

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * logits + self.b)


def labelled(docs: DataFrame, labels: DataFrame, column: str, learn: Column | None, bound: int) -> DataFrame:
    """(doc_id, text, y): at most ``bound`` labelled documents, those of the
    smallest hash of the id, over SAMPLE_TASKS tasks.  Rows without an id, text or
    label take no part; an id labelled twice counts as 1 if any of its rows says
    so; of rows that repeat an id the text of the smallest hash is learnt."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    y = y if learn is None else y.where(learn)
    y = y.groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    y = y.join(texts.select("doc_id"), "doc_id", "left_semi")  # labels of other documents don't fill the bound
    y = y.orderBy(F.xxhash64(F.lit("sample"), F.col("doc_id")), "doc_id").limit(bound)
    found = texts.join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"), F.max("y").alias("y"))
    return found.repartition(SAMPLE_TASKS, "doc_id")


def bounded(rows: DataFrame, bytes_of: Column, total: int = TRAIN_BYTES) -> DataFrame:
    """The examples, of rows with a doc_id, that fill at most ``total`` bytes: in the
    order of hashed ids, without those over a hundredth of it by themselves.  Rows are read twice."""
    rows = rows.withColumn("bytes", bytes_of).where(F.col("bytes") <= total // 100)
    place = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    sizes = rows.select(place.alias("p"), "bytes").orderBy("p").collect()  # a pair of numbers for each row of the sample
    full = np.cumsum([r["bytes"] for r in sizes])
    kept = int(np.searchsorted(full, total, side="right"))
    return rows if kept == len(sizes) else rows.where(place < F.lit(sizes[kept]["p"]))


def fetched(rows: DataFrame, bytes_of: Column, total: int = TRAIN_BYTES) -> pa.Table:
    """``bounded`` rows on the driver.  Executors keep the rows between the two readings in their
    block managers, not as files of a table: Hadoop starts a chmod for each file that a task
    writes, and until that runs it counts as a second process of the whole JVM's memory."""
    held = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return bounded(held, bytes_of, total).select(*rows.columns).toArrow()
    finally:
        held.unpersist()


def examples(rows: DataFrame, features: Features) -> list[tuple[int, np.ndarray, int]]:
    """(doc_id, coordinates, y) of a bounded sample, in the order of hashed ids; features are made on the executors."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for c in T.chunks(batch.column("text")):
                doc, at = features.of(c)
                pair = np.unique(doc.astype(np.int64) << np.int64(features.bits) | at)
                cut = np.searchsorted(pair >> features.bits, np.arange(1, c.n))
                lists += [x.astype(np.int32).tobytes() for x in np.split(pair & ((1 << features.bits) - 1), cut)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, pa.binary()), batch.column("y")], ["doc_id", "at", "y"])

    got = fetched(rows.mapInArrow(made, "doc_id long, at binary, y int"), F.length("at"))
    ids, ys = got["doc_id"].to_pylist(), got["y"].to_pylist()
    out = [(i, np.frombuffer(at.as_buffer(), np.int32), y) for i, at, y in zip(ids, got["at"], ys, strict=True)]  # views, not copies
    out.sort(key=lambda r: in_order(r[0]))
    return out


def in_order(doc_id: int) -> tuple[int, int]:
    """Examples are learnt in the order of this hash of their ids."""
    return int(T.mix(np.array([doc_id], np.int64).view(np.uint64))[0]), doc_id


def trained(rows: list[tuple[int, np.ndarray, int]], features: Features, epochs: int = 4, calibrate: float = 0.0, **rates) -> Model:
    """Passes over the examples in their order.  calibrate: the share of the
    examples, the last ones, kept out of training to fit a and b on.  Without
    examples every score is 0.5; with one class, the bias alone decides."""
    size = 1 << features.bits
    f = Ftrl(size, **rates)
    cut = len(rows) - int(len(rows) * calibrate)
    for _ in range(epochs):
        for _, at, y in rows[:cut]:
            at = np.append(at, size)
            f.learn(at, np.ones(len(at)), y)
    w = f.weights()
    model = Model(features, (at := np.flatnonzero(w[:-1])), w[:-1][at].astype(np.float32), float(w[-1]))
    if cut == len(rows):
        return model
    dense = model.dense()
    return calibrated(model, np.array([model.bias + dense[x].sum() for _, x, _ in rows[cut:]]), np.array([y for *_, y in rows[cut:]]))


def calibrated(model: Model, logits: np.ndarray, y: np.ndarray) -> Model:
    """Platt scaling with smoothed targets, by Newton steps."""
    pos = y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    x = np.stack([logits, np.ones(len(y))], 1)
    v = np.array([1.0, 0.0])
    for _ in range(30):
        p = sigmoid(x @ v)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        v = v - np.linalg.solve(h, x.T @ (p - t) + 1e-6 * (v - [1.0, 0.0]))
    if not np.isfinite(v).all() or v[0] <= 0:
        return model
    return Model(model.features, model.at, model.weight, model.bias, float(v[0]), float(v[1]))


def with_score(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """docs with a double column ``name``: the probability of label 1, for null and empty
    texts the bias's.  A column that has the name already gives way to it."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        dense = model.dense()
        for batch in batches:
            parts = [model.scores(model.logits(c, dense)) for c in T.chunks(batch.column(text))]
            score = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), score], [*kept, name])

    return docs.mapInArrow(scored, S.StructType([docs.schema[x] for x in kept]).add(name, "double"))
