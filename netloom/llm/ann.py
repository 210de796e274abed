"""Approximate nearest neighbours by collision counting.

Vectors of any norm are lifted to one sphere, where the order of distances from
a query is that of inner products.  Rows are dealt over shards of about
SHARD_ROWS by their id; a shard sorts its distinct vectors along each of
PROJECTIONS random directions.  A query's windows, centred on its own
projections, widen by GROWTH (virtual rehashing), and each vector that enters one
counts a collision.  Vectors with THRESHOLD collisions are verified by the exact
inner product.  The projections of a vector at distance d differ from the
query's by d times a normal number, so a window of half-width w holds it with
probability erf(w / d / sqrt 2): widening ends when a vector as far as the best
verified but k would have THRESHOLD collisions with probability FOUND or more,
or when the windows hold the whole shard.  The rule knows no number of rows.

A shard's rows come to its task once for each QUERY_GROUP queries; its index is
built there and the queries stream through.  Each shard's best are merged.

Cases: rows without an id, and vectors that are null, empty, zero, hold a null or a
component that is not finite, or have another length than most (ties: the longer)
take no part; of rows that repeat an id the smallest vector counts; equal vectors
are one entry of a shard, and ties in score go to the smaller id; with fewer than
k candidates all are returned; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.store import stored

SHARD_ROWS = 16_384
QUERY_GROUP = 1 << 17
#: Queries whose window edges are found together.
QUERY_BLOCK = 256
PROJECTIONS = 20
THRESHOLD = 12
FIRST_WIDTH = 0.25
GROWTH = 1.4
FOUND = 0.95
SEED = 20


def least_ratio(projections: int = PROJECTIONS, threshold: int = THRESHOLD, found: float = FOUND) -> float:
    """The least w / d at which a vector at distance d has ``threshold`` collisions with probability ``found``."""

    def enough(r: float) -> bool:
        p = math.erf(r / math.sqrt(2))
        return sum(math.comb(projections, i) * p**i * (1 - p) ** (projections - i) for i in range(threshold, projections + 1)) >= found

    lo, hi = 0.0, 8.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if enough(mid) else (mid, hi)
    return hi


class Shard:
    """Distinct vectors, sorted along each direction."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, scale: float):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        _, first, place = np.unique(vectors.view(f"V{vectors.dtype.itemsize * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
        by = np.argsort(place, kind="stable")
        self.ids, self.begin = ids[by], np.searchsorted(place[by], np.arange(len(first) + 1))
        self.vectors, self.scale, self.ratio = vectors[first], scale, least_ratio()
        unit = self.vectors / scale
        self.single = unit.astype(np.float32)
        lift = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(1)))
        self.directions = np.random.default_rng(SEED).standard_normal((PROJECTIONS, vectors.shape[1] + 1))
        at = self.directions[:, :-1] @ unit.T + np.outer(self.directions[:, -1], lift)
        self.order = np.argsort(at, axis=1)
        self.sorted = np.take_along_axis(at, self.order, 1)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of the k best verified vectors, its own row left out."""
        norm = np.sqrt((queries * queries).sum(1))
        centre = (queries / norm[:, None]) @ self.directions[:, :-1].T
        edges: list[tuple[np.ndarray, np.ndarray]] = []  # of the windows of every query, made as far as one of them needs

        def edge(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i == len(edges):
                w = FIRST_WIDTH * GROWTH**i
                edges.append(tuple(np.stack([s.searchsorted(c) for s, c in zip(self.sorted, x.T, strict=True)], 1) for x in (centre - w, centre + w)))
            return edges[i]

        for q in range(len(queries)):
            yield self._one(queries[q], float(norm[q]), int(own[q]), k, lambda i, q=q: [x[q].tolist() for x in edge(i)])

    def _one(self, query: np.ndarray, norm: float, own: int, k: int, edge) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.vectors)
        count, left = np.zeros(n, np.int64), np.ones(n, bool)  # left: not verified yet
        found, score = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        was, step, single, whole = None, 0, (query / norm).astype(np.float32), None
        while True:
            lo, hi = now = edge(step)
            if was is None:
                new = [o[a:b] for o, a, b in zip(self.order, lo, hi, strict=True)]
            else:
                new = [o[a:b] for o, l0, h0, l1, h1 in zip(self.order, *was, *now, strict=True) for a, b in ((l1, l0), (h0, h1)) if a < b]
            if new:
                count += np.bincount(np.concatenate(new), minlength=n)
                more = np.flatnonzero((count >= THRESHOLD) & left)
                left[more] = False
                found.append(more)
                if whole is None and 4 * len(more) > n:  # cheaper than to gather so many
                    whole = self.single @ single
                score.append(self.single[more] @ single if whole is None else whole[more])
            if not any(lo) and min(hi) == n:
                break
            every = np.concatenate(score)
            if len(every) > k:  # one of them may be the row itself
                worst = float(np.partition(every, len(every) - k - 1)[len(every) - k - 1])
                if FIRST_WIDTH * GROWTH**step >= self.ratio * math.sqrt(max(0.0, 2.0 - 2.0 * worst)):
                    break
            step, was = step + 1, now
        found, score = np.concatenate(found), np.concatenate(score)
        if len(found) > k + 1:  # single precision leaves room for rounding; the double product decides
            some = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1] - 2e-5
            found = found[some]
        score = (self.vectors[found] * query).sum(1)
        best = np.lexsort((self.ids[self.begin[found]], -score))[: k + 1]
        size = np.minimum(self.begin[found[best] + 1] - self.begin[found[best]], k + 1)
        ids = np.concatenate([self.ids[b : b + s] for b, s in zip(self.begin[found[best]], size, strict=True)])
        score = np.repeat(score[best], size)
        ok = ids != own
        ids, score = ids[ok], score[ok]
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]


def _usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & good & F.exists(vector, lambda x: x != 0)


def _searched(k: int, scale: float):
    """Over rows in order of (shard, part, asks): a shard's rows, then the queries that stream through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, shard = None, [], None
        for batch in batches:
            shards, parts, ids, asks = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("shard", "part", "vec_id", "asks"))
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else None
            out: list[list] = [[], [], [], []]
            edge = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | (parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])])) if len(ids) else []
            for lo, hi in zip(edge, [*edge[1:], len(ids)], strict=True):
                if (shards[lo], parts[lo]) != cell:
                    cell, rows, shard = (shards[lo], parts[lo]), [], None
                if not asks[lo]:
                    rows.append((ids[lo:hi].copy(), vectors[lo:hi].copy()))
                    continue
                if shard is None and rows:
                    shard, rows = Shard(*(np.concatenate(x) for x in zip(*rows, strict=True)), scale), []
                for at in range(lo, hi if shard else lo, QUERY_BLOCK):
                    block = slice(at, min(at + QUERY_BLOCK, hi))
                    for i, (best, score) in zip(ids[block], shard.search(vectors[block], ids[block], k), strict=True):
                        for o, x in zip(out, (i, shards[lo], best, score), strict=True):
                            o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, ty) for o, ty in zip(out, (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64())), strict=True)], ["query_id", "shard", "ids", "scores"])

    return run


def nearest(rows: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``queries`` holds, by inner product."""
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    usual = good.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    good = good.where(F.size("vector") == F.lit(usual["size"] if usual else 0))
    good = stored(good.groupBy("vec_id").agg(F.min("vector").alias("vector")), "ann_vectors")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    n, scale, asked = good.agg(F.count("*"), F.max(norm), F.count_if(queries)).first()
    shards, parts = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(asked / QUERY_GROUP))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), F.col("vec_id")), F.lit(m)).cast("int")
    stock = good.select("vec_id", "vector", F.lit(False).alias("asks"), own("shard", shards).alias("shard"), every(parts).alias("part"))
    asks = good.where(queries).select("vec_id", "vector", F.lit(True).alias("asks"), every(shards).alias("shard"), own("part", parts).alias("part"))
    dealt = stock.union(asks).repartition(shards * parts, F.col("shard"), F.col("part")).sortWithinPartitions("shard", "part", "asks")
    found = dealt.mapInArrow(_searched(k, scale), "query_id long, shard int, ids array<long>, scores array<double>")
    pairs = F.zip_with("scores", "ids", lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    best = found.select("query_id", "shard", pairs.alias("best"))
    for keys in (["query_id", F.pmod("shard", F.lit(64)).alias("part")], ["query_id"]):  # by parts first: no task reads all shards of a query
        best = best.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    out = best.select("query_id", F.posexplode("best").alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x")["i"].alias("vec_id"), (-F.col("x")["s"]).alias("score"))
