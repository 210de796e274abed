"""Language ID by Bayesian fusion of four pieces of evidence.

For each page: the likelihood of its text under hashed character n-gram models
(trained on a bounded sample of texts of known language), the declared markup
language, the address suffix, and a prior of its host.  Host counts are grouped
sums of the texts' own posteriors, smoothed hierarchically (host towards its
registered domain, that towards all pages), with the page's own share left out.
The likelihoods of declarations and suffixes come from grouped sums as well.

More than MAX_LANGUAGES language labels raise an error: none is left out silently.

Cases: a null or empty page has no text evidence; a null address counts as the
host of no name; an undeclared or unknown language is a declaration of its own;
ties go to the language first in code-point order; repeated rows are scored
alike; an empty table gives an empty result; without a training text the
languages given are equally likely; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.store import stored
from netloom.llm import textops as T
from netloom.llm import web
from netloom.operators.joins import by_key

ORDERS = (1, 2, 3)
BITS = 15
#: At most so many texts of each language train the text models; more labels than MAX_LANGUAGES are no languages.
TRAIN_TEXTS = 400
MAX_LANGUAGES = 256
SMOOTH = 0.05
#: Pages read at a time, and text whose n-grams are held at once.
SLICE_ROWS = 1000
CHUNK_BYTES = 1 << 19
#: Tasks' counts are added up in so many blocks of n-grams before the driver gets them.
COUNT_BLOCKS = 64
#: n-grams of a text are not independent: its log-likelihood counts at most as that of so many.
MAX_GRAMS = 60.0
#: Pseudo-counts: host towards domain, domain towards all; suffixes and declarations.
HOST_WEIGHT, DOMAIN_WEIGHT, KEY_WEIGHT = 5.0, 20.0, 5.0


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_likelihood: np.ndarray  # float32[n-gram, language]


def _grams(c: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) of the character n-grams inside words, words padded by a blank."""
    start, b = T.points(c.buf)
    b = np.where((b >= 65) & (b <= 90), b + np.uint64(32), b)
    blank = (b == 32) | ((b >= 9) & (b <= 13)) | ((b >= 33) & (b <= 64))
    h = T.mix(np.where(blank, np.uint64(32), b) + np.uint64(7))
    begin = np.searchsorted(start, c.doc_start)
    doc = np.repeat(np.arange(c.n), np.diff(begin))
    left = np.repeat(begin[1:], np.diff(begin)) - np.arange(len(b))
    empty = np.concatenate([[0], np.cumsum(blank)])
    docs, coords = [], []
    for k in ORDERS:
        g = T.grams(h, k)
        ok = (left[: len(g)] >= k) & (empty[k:][: len(g)] - empty[: len(g)] < min(2, k))
        docs.append(doc[: len(g)][ok])
        coords.append((g[ok] & np.uint64((1 << BITS) - 1)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(coords)


def train(docs: DataFrame, bound: int = TRAIN_TEXTS) -> Model:
    """Character n-gram models of at most ``bound`` texts of each language: those of the smallest hashed ids."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    names = sorted(r["lang"] for r in known.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct values of lang")
    known = known.where(F.col("lang").isin(names)).withColumn("place", F.xxhash64(F.lit("lang"), F.col("doc_id"), F.col("text")))
    # places only, in parts first, so that a common language fills no task; each list is cut to the bound
    least = known.select("lang", "place")
    size = known.groupBy("lang").count().collect()  # at most MAX_LANGUAGES rows
    for r in size:
        every = max(1, r["count"] // (8 * bound))
        least = least.where((F.col("lang") != r["lang"]) | (F.pmod("place", F.lit(every)) == 0))
    cut = lambda x: F.slice(F.array_sort(x), 1, bound)
    least = least.groupBy("lang", F.pmod(F.col("place"), F.lit(16)).alias("part")).agg(cut(F.collect_list("place")).alias("x"))
    least = least.groupBy("lang").agg(cut(F.flatten(F.collect_list("x"))).alias("x")).select("lang", F.explode("x").alias("place"))
    picked = known.join(F.broadcast(least), ["lang", "place"])  # at most bound places for each language
    picked = picked.groupBy("lang", "place").agg(F.min("text").alias("text")).repartition(8, "place")  # repeated rows count once

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS, len(names)), np.int64)
        for batch in batches:
            at = np.array([names.index(x) for x in batch.column("lang").to_pylist()], np.int64)
            for c in T.chunks(batch.column("text"), CHUNK_BYTES):
                doc, coord = _grams(c)
                np.add.at(total, (coord, at[c.row0 + doc]), 1)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        if len(at):
            ends = pa.array(np.searchsorted(at, np.arange(COUNT_BLOCKS + 1) * (flat.size // COUNT_BLOCKS)), pa.int32())
            held = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((at, pa.int32()), (flat[at], pa.int64()))]
            batch = pa.RecordBatch.from_arrays([pa.array(range(COUNT_BLOCKS), pa.int32()), *held], ["block", "at", "n"])
            yield from (batch.slice(i, 1) for i in range(COUNT_BLOCKS))

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = key[0].as_py()
        out = np.zeros((1 << BITS) // COUNT_BLOCKS * len(names), np.int64)
        for batch in batches:
            np.add.at(out, batch.column("at").flatten().to_numpy() - block * len(out), batch.column("n").flatten().to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["block", "counts"])

    total = np.zeros((1 << BITS, len(names)))
    if names:
        blocks = picked.select("lang", "text").mapInArrow(counted, "block int, at array<int>, n array<long>").groupBy("block").applyInArrow(merged, "block int, counts binary")
        for r in blocks.collect():  # COUNT_BLOCKS rows of fixed size, however many tasks count
            total.reshape(COUNT_BLOCKS, -1)[r["block"]] = np.frombuffer(r["counts"], np.int64)
        size = total.sum(0) + SMOOTH * len(total)
        total += SMOOTH
        total /= size
        np.log(total, out=total)
    return Model(names, total.astype(np.float32))


def _read(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        declared = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]+)", re.I)
        for batch in (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
            pages = batch.column("html").to_pylist()
            langs = [(m[1].lower() if p and (m := declared.search(p)) else "") for p in pages]
            langs = [x if x in model.languages else "other" if x else "" for x in langs]
            rows = []
            for c in T.chunks(pa.array([web.visible(p) if p else "" for p in pages], pa.string()), CHUNK_BYTES):
                doc, at = _grams(c)
                total = np.stack([np.bincount(doc, model.log_likelihood[at, j], minlength=c.n) for j in range(len(model.languages))], 1)
                n = np.maximum(np.bincount(doc, minlength=c.n), 1)
                rows.append(total * np.minimum(1.0, MAX_GRAMS / n)[:, None])
            scores = np.concatenate(rows) if rows else np.zeros((0, len(model.languages)))
            keep = [batch.column(x) for x in ("page_id", "host")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(langs, pa.string()), pa.array(list(scores), pa.list_(pa.float64()))], ["page_id", "host", "declared", "text"])

    return run


def _softmax(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _evidence(model: Model):
    """What _read gives, and each text's own posterior."""
    read = _read(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read(batches):
            own = _softmax(_matrix(batch.column("text"), len(model.languages)))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(own)], [*batch.schema.names, "own"])

    return run


def _fused(languages: list[str], every: list[float]):
    """The verdict of each page; h, d, s and m: the sums of its host, domain, suffix and declaration."""
    k, n, all_pages = len(languages), sum(every), np.array(every)
    base = (all_pages + 1.0) / (n + k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
            t, p, h, d, s, m = (_matrix(batch.column(x), k) for x in ("text", "own", "h", "d", "s", "m"))
            left = lambda x, p=p: np.maximum(0.0, x - p)
            size = lambda x: x.sum(1, keepdims=True)
            domain = (left(d) + DOMAIN_WEIGHT * base) / (size(d) - 1 + DOMAIN_WEIGHT)
            prior = (left(h) + HOST_WEIGHT * domain) / (size(h) - 1 + HOST_WEIGHT)
            own_total = all_pages - p + KEY_WEIGHT
            share = [(left(x) + KEY_WEIGHT * size(x) / max(n, 1.0)) / own_total for x in (s, m)]
            q = _softmax(t + np.log(prior) + np.log(share[0]) + np.log(share[1]))
            named = [pa.array([languages[j] for j in x.argmax(1)], pa.string()) for x in (q, p)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), named[0], pa.array(q.max(1)), named[1], batch.column("declared"), batch.column("host")],
                ["page_id", "lang", "probability", "text_lang", "declared", "host"],
            )

    return run


def identify(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, lang, probability, text_lang, declared, host: one row for each row of pages."""
    k = len(model.languages)
    if not k:
        return pages.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit("").alias("declared"), web.host(F.col("url")).alias("host"))
    read = pages.select("page_id", web.host(F.col("url")).alias("host"), "html").mapInArrow(_evidence(model), "page_id long, host string, declared string, text array<double>, own array<double>")
    read = stored(read.withColumns({"domain": F.regexp_extract("host", r"([^.]+\.[^.]+)$|^([^.]+)$", 0), "suffix": F.substring_index("host", ".", -1)}), "language_evidence")
    # expressions grow with the languages, not with their square: the driver holds the plan
    sums = [F.sum(F.col("own")[j]) for j in range(k)]
    every = [float(x or 0.0) for x in read.agg(*sums).first()]
    out = read
    for key, name in (("host", "h"), ("domain", "d"), ("suffix", "s"), ("declared", "m")):
        out = by_key(out, stored(read.groupBy(key).agg(F.array(*sums).alias(name)), f"language_{key}"), key)
    out = out.select("page_id", "host", "declared", "text", "own", "h", "d", "s", "m")
    return out.mapInArrow(_fused(model.languages, every), "page_id long, lang string, probability double, text_lang string, declared string, host string")
