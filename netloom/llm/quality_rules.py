"""Quality rules: counted base rules, then a calibrated hashed n-gram model against a fixed threshold.

The model is logistic regression over the distinct word n-grams of a text and
over the shares of its words' character n-grams, trained by FTRL updates on a
bounded sample of labelled quality rows, then Platt-calibrated on a part of the
sample kept out of training.  Arrow batches are scored against THRESHOLD.

Cases: null and empty texts have no words and fail the base rules; repeated rows
get equal results; a text of any length is counted whole; without labelled rows
the model keeps what the base rules keep; an empty table gives an empty result;
other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from netloom.llm import linear
from netloom.llm import textops as T

WORDS = linear.Features(bits=20, orders=(1, 2, 4), repeats=True)
CHAR_ORDERS = (2, 3)
CHAR_BITS = 16
#: Character n-gram shares are multiplied by this, so that they learn as fast as word n-grams.
CHAR_SCALE = 20.0
#: At most so many labelled documents train and calibrate the model.
TRAIN_ROWS = 8_000
CALIBRATE = 0.2
EPOCHS = 3
RATES = {"alpha": 1.0, "beta": 1.0, "l1": 1.0, "l2": 0.1}
THRESHOLD = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(c: T.Chunk, w: T.Words) -> np.ndarray:
    """Words in 5-word windows found twice or more in the text, the first included."""
    g = T.grams(w.hash, WINDOW)
    if not len(g):
        return np.zeros(c.n, np.int64)
    inside = np.flatnonzero(w.left()[: len(g)] >= WINDOW)
    key = T.mix(g[inside] + w.doc[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, inside[twice], 1)
    np.add.at(edge, inside[twice] + WINDOW, -1)
    return T.segment_sums(np.cumsum(edge[:-1]) > 0, w.doc_word)


def duplicate_lines(c: T.Chunk, w: T.Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    if not len(c.buf):
        return np.zeros(c.n, np.int64)
    first = np.zeros(len(c.buf) + 1, bool)
    first[c.doc_start[:-1]] = True
    first[1:] |= c.buf == 10
    start = np.flatnonzero(first[:-1])
    stop = np.append(start[1:], len(c.buf))
    stop = stop - (c.buf[stop - 1] == 10)
    worded = np.searchsorted(w.start, stop) > np.searchsorted(w.start, start)
    start, stop = start[worded], stop[worded]
    doc = np.searchsorted(c.doc_start, start, side="right") - 1
    key = T.mix(T.span_hash(c.buf, start, stop - start) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, kept = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=c.n) - np.bincount(doc[kept], minlength=c.n)


def counted(c: T.Chunk, w: T.Words) -> dict[str, np.ndarray]:
    return {
        "n_words": np.diff(w.doc_word),
        "word_chars": T.code_points(c, w),
        "n_symbols": T.segment_sums(T.char_flags(c.buf, SYMBOLS), c.doc_start),
        "n_dup_lines": duplicate_lines(c, w),
        "n_repeat_words": repeated_words(c, w),
    }


def distinct_words(c: T.Chunk, w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, lengths, place of each word): the distinct words one after another."""
    _, first, place = np.unique(w.hash, return_index=True, return_inverse=True)
    length = (w.end - w.start)[first]
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return c.buf[np.repeat(w.start[first], length) + at], length, place


def char_grams(buf: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, coordinate) of every n-gram of code points inside words."""
    start, value = T.points(buf)
    size = np.diff(np.searchsorted(start, np.append(0, np.cumsum(length))))
    word = np.repeat(np.arange(len(size)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(value))
    h, words, coords = T.mix(value + np.uint64(1)), [], []
    for k in CHAR_ORDERS:
        g = T.grams(h, k)
        ok = left[: len(g)] >= k
        words.append(word[: len(g)][ok])
        coords.append((g[ok] & np.uint64((1 << CHAR_BITS) - 1)).astype(np.int64))
    return np.concatenate(words), np.concatenate(coords)


@dataclass(frozen=True)
class Model:
    words: linear.Model
    chars: np.ndarray  # weights of the character n-grams

    def logits(self, c: T.Chunk, w: T.Words, dense: np.ndarray) -> np.ndarray:
        out = self.words.logits(c, dense, w)
        if not len(w):
            return out
        buf, length, place = distinct_words(c, w)
        word, at = char_grams(buf, length)
        n = np.bincount(word, minlength=len(length))
        total = np.bincount(word, self.chars[at], minlength=len(length))
        docs = np.bincount(w.doc, n[place], minlength=c.n)
        return out + CHAR_SCALE * np.bincount(w.doc, total[place], minlength=c.n) / np.maximum(docs, 1)


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> Model | None:
    """The model of a bounded sample of labelled rows; None without any."""
    rows = linear.labelled(docs, labels, "quality", None, bound)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats, grams, counts = [], [], []
            for c in T.chunks(batch.column("text")):
                w = T.words(c)
                doc, at = WORDS.of(c, w)
                pair = np.unique(doc.astype(np.int64) << np.int64(WORDS.bits) | at)
                cut = np.searchsorted(pair >> WORDS.bits, np.arange(1, c.n))
                ats += [x.astype(np.int32).tobytes() for x in np.split(pair & ((1 << WORDS.bits) - 1), cut)]
                key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(w):
                    buf, length, place = distinct_words(c, w)
                    word, gram = char_grams(buf, length)
                    n = np.bincount(word, minlength=len(length))
                    begin = np.cumsum(n) - n
                    order = np.argsort(word, kind="stable")
                    size = n[place]
                    flat = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[place], size)]
                    key, count = np.unique(np.repeat(w.doc, size).astype(np.int64) << np.int64(CHAR_BITS) | gram[flat], return_counts=True)
                cut = np.searchsorted(key >> CHAR_BITS, np.arange(1, c.n))
                grams += [x.astype(np.uint16).tobytes() for x in np.split(key & ((1 << CHAR_BITS) - 1), cut)]
                counts += [x.astype(np.uint32).tobytes() for x in np.split(count, cut)]
            cols = [batch.column("doc_id"), *(pa.array(x, pa.binary()) for x in (ats, grams, counts)), batch.column("y")]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "at", "gram", "n", "y"])

    size = sum((F.length(x) for x in ("gram", "n")), F.length("at"))
    got = linear.fetched(rows.mapInArrow(made, "doc_id long, at binary, gram binary, n binary, y int"), size)
    if not got.num_rows:
        return None
    order = sorted(range(got.num_rows), key=lambda i, ids=got["doc_id"].to_pylist(): linear.in_order(ids[i]))
    views = [[np.frombuffer(x.as_buffer(), t) for x in got[name]] for name, t in (("at", np.int32), ("gram", np.uint16), ("n", np.uint32))]
    ys = got["y"].to_pylist()
    size, cut = (1 << WORDS.bits) + (1 << CHAR_BITS), len(order) - int(len(order) * CALIBRATE)

    def example(i: int) -> tuple[np.ndarray, np.ndarray]:
        at, gram, n = (v[i] for v in views)
        share = (n * (CHAR_SCALE / max(int(n.sum()), 1))).astype(np.float32)
        return np.concatenate([at, gram.astype(np.int32) + (1 << WORDS.bits), [size]]), np.concatenate([np.ones(len(at), np.float32), share, [1.0]])

    f = linear.Ftrl(size, **RATES)
    for _ in range(EPOCHS):
        for i in order[:cut]:
            f.learn(*example(i), ys[i])
    w = f.weights()
    some = np.flatnonzero(w[: 1 << WORDS.bits])
    model = linear.Model(WORDS, some, w[some].astype(np.float32), float(w[-1]))
    if cut < len(order):
        logits = np.array([w[at] @ value for at, value in map(example, order[cut:])])
        model = linear.calibrated(model, logits, np.array([ys[i] for i in order[cut:]]))
    return Model(model, w[1 << WORDS.bits : -1])


def judged(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with n_words, the four base counts, base_failed, quality and kept, in place of columns of these names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [*COUNTS, "base_failed", "quality", "kept"]
    left = [c for c in docs.columns if c.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        dense = model and model.words.dense()
        for batch in batches:
            parts: list[dict] = []
            for c in T.chunks(batch.column(text)):
                w = T.words(c)
                x = counted(c, w)
                x["base_failed"] = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"])
                x["quality"] = model.words.scores(model.logits(c, w, dense)) if model else np.ones(c.n)
                x["kept"] = ~x["base_failed"] & (x["quality"] >= THRESHOLD)
                parts.append(x)
            if parts:
                cols = [pa.array(np.concatenate([x[n] for x in parts])) for n in names]
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in left), *cols], [*left, *names])

    schema = S.StructType([docs.schema[x] for x in left])
    for n in names:
        schema = schema.add(n, {"base_failed": "boolean", "kept": "boolean", "quality": "double"}.get(n, "long"))
    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality."""
    return judged(docs.select("doc_id", "text"), fit(docs, labels, bound)).select("doc_id", *COUNTS, "base_failed", "kept", "quality")
