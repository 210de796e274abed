"""N-gram Jaccard join with adaptive multi-match prefixes, and its components.

A document's set holds the hashes of its distinct word n-grams.  Documents of
equal sets form a class; everything below works on classes.

Sets are ordered by estimated document frequency (a count sketch of fixed size
over all documents), then by hash.  If two sets of sizes n and m reach the
threshold t, their overlap is at least ceil(t n) and ceil(t m); so their
prefixes of n - ceil(t n) + l and m - ceil(t m) + l tokens share l tokens or
more.  Each set takes the l, up to MAX_MATCHES, of the least estimated cost:
a longer prefix reads more postings, but a pair is verified only if it shares
min(l, l') prefix tokens.

The pairs of rare tokens are counted.  Those with enough matches are held against
the sets' parity bitmaps, of about a bit for each token: two sets differ in no
fewer tokens than their bitmaps do in bits, so a pair whose bitmaps differ too
much is no link.  Only what is left is verified by the whole sets, in steps of
bounded size.  A pair that shares a frequent prefix token (of many near
copies, or of a passage that fills short documents) is compared at the first one
of them instead.  The members of a frequent token are dealt by hash over parts of
about CHUNK, as many as its estimate asks for, so that no task reads them all; the
pairs of a part, or of two parts, that no earlier token compares are verified
together, by matrix products within one task, which gives at most a link for each
member instead of a row for each pair.  As the estimate's noise grows with the
corpus, a token that it calls rare is treated so too if more than RARE_MEMBERS
documents have it in their prefixes.

A member carries the frequent tokens ahead of one, of many only the BEFORE of
smallest hash: one that two members share proves that an earlier token compares
them, and a proof that is missed costs time but no link.

Cases: texts that are null or without words have an empty set and are linked
with nothing; fewer than ``k`` words make one shingle of them all; repeated rows
are one class, each with its row; null ids take part, but name no component
unless all ids of it are null; different texts under one id are told apart by a
hash of the text; an empty table gives an empty result; other columns are kept by
``first_of_each``.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import textops as T
from netloom.llm.mixing import fresh
from netloom.functions.store import discard, stored

SHINGLE = 4
PERCENT = 85
#: Counters of the frequency sketch: its size does not depend on the corpus.
SKETCH_BITS = 21
SKETCH_BLOCKS = 64
MAX_MATCHES = 8
#: Cost of verifying a candidate, in postings read.
VERIFY_COST = 30.0
CHUNK = 4096
#: Up to so many documents a token is rare, as far as its counter's noise lets that be told; and for certain.
RARE_COUNT = 16
RARE_MEMBERS = 64
BEFORE = 128
#: A class with more than this share of all rows is hot.
HOT_SHARE = 2000
#: Tokens in a chunk's sets, at most (one larger set makes a chunk of its own).
CHUNK_TOKENS = 2_000_000


def sets_of(c: T.Chunk, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a chunk."""
    w = T.words(c, lower=True)
    g = T.grams(w.hash, k)
    few = np.diff(w.doc_word)
    inside = np.flatnonzero(w.left()[: len(g)] >= k)
    doc = w.doc[inside]
    order = np.lexsort((g[inside], doc))
    doc, h = doc[order], g[inside][order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    bounds = np.searchsorted(doc, np.arange(c.n + 1))
    for i in range(c.n):
        if 0 < few[i] < k:
            yield T.grams(w.hash[w.doc_word[i] : w.doc_word[i + 1]], int(few[i]))
        else:
            yield h[bounds[i] : bounds[i + 1]]


def set_key(s: np.ndarray) -> int:
    """A hash of a set, 0 for the empty one."""
    return int(T.mix(np.array([np.add.reduce(T.mix(s * np.uint64(5)), dtype=np.uint64) ^ np.uint64(len(s))]))[0].view(np.int64)) or 1 if len(s) else 0


#: Bits of the smallest parity bitmap.
LEAST_BITS = 64


def parity(s: np.ndarray) -> bytes:
    """A bit for each value of the low bits of a set's hashes: whether an odd number of them has it.  As many bits as the next power of two from the set's size."""
    bits = max(LEAST_BITS, 1 << (len(s) - 1).bit_length()) if len(s) else LEAST_BITS
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """In how many tokens two sets differ at least, by their parity bitmaps; the longer one is folded to the other's length."""
    if len(a) < len(b):
        a, b = b, a
    x, bits = int.from_bytes(a, "little"), 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = (x & ((1 << bits) - 1)) ^ (x >> bits)
    return (x ^ int.from_bytes(b, "little")).bit_count()


SIGNED = "id long, tie long, key long, n int, bits binary, block int, counts binary"
SIGNED_NAMES = [x.split()[0] for x in SIGNED.split(", ")]


def _signed(k: int):
    """(id, tie, set key, set size, parity bitmap) of each document, and at a partition's end the blocks of its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint16)
        for batch in batches:
            keys, sizes, bits = [], [], []
            for c in T.chunks(batch.column("text")):
                sets = list(sets_of(c, k))
                keys += map(set_key, sets)
                sizes += map(len, sets)
                bits += map(parity, sets)
                at, n = np.unique(np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                counts[at] = np.minimum(counts[at] + n, 65_535)
            ids = batch.column("id")
            none = pa.nulls(len(ids))
            yield pa.RecordBatch.from_arrays([ids, batch.column("tie"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], SIGNED_NAMES)
        if counts.any():
            blocks = counts.reshape(SKETCH_BLOCKS, -1)
            none = pa.nulls(SKETCH_BLOCKS)
            yield pa.RecordBatch.from_arrays(
                [*[none.cast(pa.int64())] * 3, none.cast(pa.int32()), none.cast(pa.binary()), pa.array(np.arange(SKETCH_BLOCKS, dtype=np.int32)), pa.array([b.tobytes() for b in blocks], pa.binary())],
                SIGNED_NAMES,
            )

    return run


def _summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCKS, np.int64)
    for batch in batches:
        for x in batch.column("counts"):
            total += np.frombuffer(x.as_py(), np.uint16 if len(x.as_py()) == 2 * len(total) else np.int32)
    total = np.minimum(total, 1 << 30).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])


def sketch_of(blocks: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches, summed in two steps so that no task reads them all."""
    first = blocks.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(16)))
    for keys in (["block", "salt"], ["block"]):
        first = first.groupBy(*keys).applyInArrow(_summed, "block int, counts binary")
    out = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.int32)
    for r in first.collect():  # SKETCH_BLOCKS rows, whatever the corpus
        out[r["block"]] = np.frombuffer(r["counts"], np.int32)
    return out.ravel()


def prefix(s: np.ndarray, sketch: np.ndarray, mean: float, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The prefix of a set, over how many parts each of its tokens is dealt (0: a rare one), and the matches that it asks for."""
    n = len(s)
    need = -(-percent * n // 100)
    estimate = sketch[s >> np.uint64(64 - SKETCH_BITS)]
    limit = mean + max(RARE_COUNT, 3 * np.sqrt(mean))  # a counter holds other tokens' counts too: mean of them, give or take its root
    level = np.ceil(np.log2(np.maximum(estimate / limit, 1.0))).astype(np.int64)
    order = np.lexsort((s, level))
    cost = np.cumsum(np.maximum(1.0, estimate[order] - mean))
    matches = np.arange(1, min(MAX_MATCHES, need) + 1)
    read = cost[n - need + matches - 1]
    best = int(matches[np.argmin(read * (1 + VERIFY_COST / matches**2))])
    order = order[: n - need + best]
    parts = np.maximum(1, np.ceil((estimate[order] - mean) / (0.9 * CHUNK))).astype(np.int64)
    return s[order], np.where(level[order] > 0, parts, 0), best


def earlier(tokens: np.ndarray) -> list[bytes]:
    """For each of a set's frequent tokens the ones ahead of it, at most the BEFORE of smallest hash."""
    raw = tokens.tobytes()
    out = [raw[: 8 * i] for i in range(min(len(tokens), BEFORE + 1))]
    if len(tokens) > len(out):
        place = T.mix(tokens ^ np.uint64(0x5BD1E995))
        held = sorted(zip(place[:BEFORE].tolist(), tokens[:BEFORE].tolist(), strict=True))
        for h, t in zip(place[BEFORE:-1].tolist(), tokens[BEFORE:-1].tolist(), strict=True):
            if h < held[-1][0]:
                held.pop()
                bisect.insort(held, (h, t))
                out.append(np.array([x for _, x in held], np.uint64).tobytes())
            else:
                out.append(out[-1])
    return out


PREFIXED = "token long, part int, parts int, key long, n int, l int, before binary"
#: Prefix tokens, and earlier ones with them, that a task holds at a time.
OUT_TOKENS = 4_000_000


def _prefixes(k: int, percent: int, sent):
    """(token, part, parts, key, n, l, before) of each prefix token; before: for a
    frequent token those ahead of it in the prefix, otherwise null."""

    def made(parts: list[tuple]) -> pa.RecordBatch:
        size = [len(p[0]) for p in parts]
        key, n, ask = (np.repeat(np.array([p[i] for p in parts], t), size) for i, t in ((1, np.int64), (2, np.int32), (3, np.int32)))
        dealt = np.concatenate([p[5] for p in parts])
        part = (key % np.maximum(dealt, 1)).astype(np.int32)
        cols = [np.concatenate([p[0] for p in parts]).view(np.int64), part, np.maximum(dealt, 1).astype(np.int32), key, n, ask]
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols), pa.array([b for p in parts for b in p[4]], pa.binary())], [x.split()[0] for x in PREFIXED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = sent.value
        mean = float(sketch.mean())
        for batch in batches:
            seen: set[int] = set()
            parts: list[tuple] = []
            held = 0
            for c in T.chunks(batch.column("text")):
                for s in sets_of(c, k):
                    if len(s) and (key := set_key(s)) not in seen:
                        seen.add(key)
                        tokens, dealt, matches = prefix(s, sketch, mean, percent)
                        first = len(tokens) - int((dealt > 0).sum())  # the order puts frequent tokens last
                        parts.append((tokens, key, len(s), matches, [None] * first + earlier(tokens[first:]), dealt))
                        held += len(tokens) + sum(map(len, parts[-1][4][first:])) // 8
                if held > OUT_TOKENS:
                    yield made(parts)
                    parts, held = [], 0
            if parts:
                yield made(parts)

    return run


#: Pairs of documents that share a rare prefix token, and chunks of the documents that share a frequent one.
MET = "x long, y long, ask int, token long, chunk long, keys binary, sizes binary, counts binary, before binary"


def _met(percent: int):
    """Over rows in order of (token, part, key)."""

    def pairs(token, key, n, ask) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])  # copies of a class that were read apart
        token, key, n, ask = token[new], key[new], n[new], ask[new]
        begin = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(token)))
        if (size > RARE_MEMBERS).any():
            for b, m in zip(begin[size > RARE_MEMBERS].tolist(), size[size > RARE_MEMBERS].tolist(), strict=True):
                yield from chunks(int(token[b]), [(x, y, b"") for x, y in zip(key[b : b + m].tolist(), n[b : b + m].tolist(), strict=True)])
            few = np.repeat(size <= RARE_MEMBERS, size)
            token, key, n, ask = token[few], key[few], n[few], ask[few]
        xs, ys, asks, gap = [], [], [], 1
        at = np.arange(len(token))
        while len(at := at[at + gap < len(token)]) and len(at := at[token[at] == token[at + gap]]):
            a, b = n[at].astype(np.int64), n[at + gap].astype(np.int64)
            ok = at[(100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (key[at] != key[at + gap])]
            xs.append(np.minimum(key[ok], key[ok + gap]))
            ys.append(np.maximum(key[ok], key[ok + gap]))
            asks.append(np.minimum(ask[ok], ask[ok + gap]))
            gap += 1
        x, y, ask = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys, asks))
        none = [pa.nulls(len(x), t) for t in (pa.int64(), pa.int64(), *[pa.binary()] * 4)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(ask.astype(np.int32)), *none], NAMES)

    def chunks(token: int, members: list[tuple]) -> Iterator[pa.RecordBatch]:
        no, begin, held = 0, 0, 0
        for i, m in enumerate(members):
            if i > begin and (i - begin == CHUNK or held + m[1] > CHUNK_TOKENS):
                yield chunk(token, no, members[begin:i])
                no, begin, held = no + 1, i, 0
            held += m[1]
        yield chunk(token, no, members[begin:])

    def chunk(token, no, members) -> pa.RecordBatch:
        keys, sizes, before = zip(*members, strict=True)
        cols = [np.array(keys, np.int64).tobytes(), np.array(sizes, np.int32).tobytes(), np.array([len(b) // 8 for b in before], np.int32).tobytes(), b"".join(before)]
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32())]
        return pa.RecordBatch.from_arrays([*none, pa.array([token], pa.int64()), pa.array([no], pa.int64()), *(pa.array([c], pa.binary()) for c in cols)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple | None = None  # rare rows of the last token, which the next batch may continue
        hot: list = [None, 0, 0, []]  # (token, part, parts), chunks before, tokens in its sets, members

        def cut() -> Iterator[pa.RecordBatch]:
            (token, part, parts), no, _, members = hot
            if len(members) > (no == 0 and parts == 1):  # one member alone meets nobody
                yield chunk(token, no * parts + part, members)

        for batch in batches:
            rare = batch.column("before").is_null().to_numpy(zero_copy_only=False)
            cols = [batch.column(x).to_numpy() for x in ("token", "key", "n", "l")]
            few = [c[rare] for c in cols]
            if rest is not None:
                few = [np.concatenate([r, c]) for r, c in zip(rest, few, strict=True)]
            if len(few[0]):
                last = int(np.searchsorted(few[0], few[0][-1]))
                yield from pairs(*(c[:last] for c in few))
                rest = tuple(c[last:] for c in few)
            many = np.flatnonzero(~rare)
            before = batch.column("before").take(pa.array(many)).to_pylist()
            dealt = (batch.column(x).to_numpy()[many].tolist() for x in ("part", "parts"))
            for token, key, n, b, part, parts in zip(*(c[many].tolist() for c in cols[:3]), before, *dealt, strict=True):
                if (token, part, parts) != hot[0]:
                    if hot[0]:
                        yield from cut()
                    hot = [(token, part, parts), 0, 0, []]
                if hot[3] and hot[3][-1][0] == key:
                    continue
                if len(hot[3]) == CHUNK or hot[3] and hot[2] + n > CHUNK_TOKENS:
                    yield from cut()
                    hot = [hot[0], hot[1] + 1, 0, []]
                hot[3].append((key, n, b))
                hot[2] += n
        if rest is not None:
            yield from pairs(*rest)
        if hot[0]:
            yield from cut()

    return run


NAMES = [x.split()[0] for x in MET.split(", ")]


def _opened(keys: bytes, sizes: bytes, counts: bytes, before: bytes) -> tuple:
    n = np.frombuffer(counts, np.int32)
    return np.frombuffer(keys, np.int64), np.frombuffer(sizes, np.int32).astype(np.int64), n, np.frombuffer(before, np.int64)


def _needed(a: tuple, b: tuple, same: bool, percent: int) -> np.ndarray:
    """[a, b]: pairs of fitting sizes that no earlier frequent token compares.  same: a and b are one chunk, each pair counts once."""
    need = _shared([(a[2], a[3]), (b[2], b[3])]) == 0
    need &= 100 * np.minimum(a[1][:, None], b[1][None, :]) >= percent * np.maximum(a[1][:, None], b[1][None, :])
    need &= a[0][:, None] != b[0][None, :]
    return np.triu(need, 1) if same else need


def _shared(sides: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """[a, b]: how many items each member of one side shares with each of the other, by
    products of 0/1 matrices of 1024 items at a time.  A side: the members' numbers of items, and the items."""
    (na, a), (nb, b) = sides
    words, at, n = np.unique(np.concatenate([a, b]), return_inverse=True, return_counts=True)
    rank = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[at]
    row = np.repeat(np.arange(len(na) + len(nb)), np.concatenate([na, nb]))
    row, rank = row[rank >= 0], rank[rank >= 0]
    order = np.argsort(rank, kind="stable")
    row, rank = row[order], rank[order]
    shared = np.zeros((len(na), len(nb)), np.float32)
    for lo in range(0, int(rank[-1]) + 1 if len(rank) else 0, 1024):
        i, j = np.searchsorted(rank, [lo, lo + 1024])
        m = np.zeros((len(na) + len(nb), min(1024, int(rank[-1]) + 1 - lo)), np.float32)
        m[row[i:j], rank[i:j] - lo] = 1
        shared += m[: len(na)] @ m[len(na) :].T
    return shared


#: Pairs to verify by themselves, or members of a block to verify together.
PLANNED = "x long, y long, token long, c1 long, c2 long, side int, key long, n int, before binary"


def _planned(percent: int):
    """A chunk's pairs (or two chunks'): by themselves if they are few, or as a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("keys", "sizes", "counts", "before")
        for batch in batches:
            rows: list[list] = [[] for _ in range(9)]
            for r in batch.to_pylist():
                a = _opened(*(r[f] for f in fields))
                same = r["chunk2"] is None
                b = a if same else _opened(*(r[f + "2"] for f in fields))
                need = _needed(a, b, same, percent)
                i, j = np.nonzero(need)
                if len(i) <= 4 * (len(a[0]) + len(b[0])):
                    out = [np.minimum(a[0][i], b[0][j]).tolist(), np.maximum(a[0][i], b[0][j]).tolist(), *[[None] * len(i)] * 7]
                    for o, v in zip(rows, out, strict=True):
                        o.extend(v)
                    continue
                for side, m, used in ((0, a, need.any(1) | need.any(0) if same else need.any(1)), (1, b, need.any(0)))[: 1 if same else 2]:
                    ends = np.cumsum(m[2])
                    for p in np.flatnonzero(used).tolist():
                        values = (None, None, r["token"], r["chunk"], -1 if same else r["chunk2"], side, int(m[0][p]), int(m[1][p]), m[3][ends[p] - m[2][p] : ends[p]].tobytes())
                        for o, v in zip(rows, values, strict=True):
                            o.append(v)
            types = [pa.int64()] * 5 + [pa.int32()] + [pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types, strict=True)], [x.split()[0] for x in PLANNED.split(", ")])

    return run


def _block(percent: int, every: bool):
    """Verifies the pairs of a block by products of 0/1 matrices over the tokens that
    two or more of its sets hold; gives every link, or links that join what is linked."""

    def run(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        parts = []
        for s in sorted(set(side.tolist())):
            p = t.filter(pa.array(side == s))
            before = p["before"].to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in p["items"].to_pylist()]
            parts.append(((p["key"].to_numpy(), p["n"].to_numpy().astype(np.int64), np.array([len(b) // 8 for b in before]), np.frombuffer(b"".join(before), np.int64)), sets))
        (a, sa), (b, sb) = parts[0], parts[-1]
        same = len(parts) == 1
        need = _needed(a, b, same, percent)
        both = _shared([(np.array([len(s) for s in x]), np.concatenate(x)) for x in (sa, sb)]).astype(np.int64)
        i, j = np.nonzero(need & (100 * both >= percent * (a[1][:, None] + b[1][None, :] - both)))
        parent: dict[int, int] = {}

        def find(v: int) -> int:
            while (p := parent.setdefault(v, v)) != v:
                parent[v] = parent[p]
                v = parent[p]
            return v

        xs, ys = [], []
        for x, y in zip(a[0][i].tolist(), b[0][j].tolist(), strict=True):
            if every or (u := find(x)) != (v := find(y)):
                if not every:
                    parent[u] = v
                xs.append(x)
                ys.append(y)
        return pa.table([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    return run


#: Bits of the filter of wanted documents: its size does not depend on the corpus.
WANTED_BITS = 26
WANTED_BLOCKS = 64


def _marked(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros((1 << WANTED_BITS) // WANTED_BLOCKS, bool)
    for batch in batches:
        bits[batch.column("place").to_numpy() // WANTED_BLOCKS] = True
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["block", "bits"])


def _place(of: str = ""):
    """The bit of a document (id, tie) in the filter."""
    return F.pmod(F.xxhash64(of + "id", of + "tie"), F.lit(1 << WANTED_BITS))


def filter_of(wanted: DataFrame) -> np.ndarray:
    """[block, byte]: the bits of wanted documents (id, tie).  It may let others through, and holds none back."""
    return _bits(wanted.select(_place().alias("place")))


def _bits(places: DataFrame) -> np.ndarray:
    out = np.zeros((WANTED_BLOCKS, (1 << WANTED_BITS) // WANTED_BLOCKS // 8), np.uint8)
    marked = places.groupBy(F.pmod("place", F.lit(WANTED_BLOCKS)).alias("block")).applyInArrow(_marked, "block long, bits binary")
    for r in marked.collect():  # WANTED_BLOCKS rows, whatever the corpus
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def _within(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    at = place // WANTED_BLOCKS
    return (bits[place % WANTED_BLOCKS, at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


def _whole_sets(k: int, sent):
    """(key, items) of the documents (place, text) that the filter lets through: their texts are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            picked = batch.column("text").filter(pa.array(_within(bits, batch.column("place").to_numpy())))
            for c in T.chunks(picked) if len(picked) else ():
                sets = list(sets_of(c, k))
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "items"])

    return run


def _likely(percent: int):
    """Of pairs (x, y, a, b: sizes, p, q: parity bitmaps) those that may be links, with the bytes of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("a").to_numpy().astype(np.int64) + batch.column("b").to_numpy()
            least = np.array([apart(p, q) for p, q in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist(), strict=True)], np.int64)
            mask = pa.array((100 + percent) * least <= (100 - percent) * n)
            yield pa.RecordBatch.from_arrays([*(batch.column(x).filter(mask) for x in ("x", "y")), pa.array(8 * n).filter(mask)], ["x", "y", "size"])

    return run


#: Bytes of whole sets that are shuffled at a time, about.
SETS_AT_A_TIME = 2_000_000_000


def _of(i: int, n: int, *columns: str):
    """Whether a row belongs to step i of n."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)) == i


def _verified_links(pairs: DataFrame, members: DataFrame, sets: DataFrame, percent: int, every: bool) -> list[DataFrame]:
    """Stored tables of links (x, y), each of a step of the pairs (x, y, size) or of the members of blocks."""
    held = sets.agg(F.sum(F.length("items"))).first()[0] or 0
    paired = pairs.agg(F.sum("size")).first()[0] or 0
    n = math.ceil(math.sqrt((2 * held + paired) / SETS_AT_A_TIME)) or 1
    links = []
    for i, j in itertools.product(range(n), repeat=2):  # a step: the pairs of an n-th of the sets and another n-th
        a = sets.where(_of(i, n, "key")).select(F.col("key").alias("x"), F.col("items").alias("a"))
        b = sets.where(_of(j, n, "key")).select(F.col("key").alias("y"), F.col("items").alias("b"))
        both = pairs.where(_of(i, n, "x") & _of(j, n, "y")).select("x", "y").join(a, "x").join(b, "y")
        links.append(stored(both.mapInArrow(_verified(percent), "x long, y long"), "join_links"))
    grouped = members.agg(F.sum(8 * F.col("n").cast("long"))).first()[0] or 0
    n = math.ceil(grouped / SETS_AT_A_TIME) or 1
    for i in range(n):
        some = members.where(_of(i, n, "token", "c1", "c2")).join(sets, "key")
        links.append(stored(some.groupBy("token", "c1", "c2").applyInArrow(_block(percent, every), "x long, y long"), "join_links"))
    return links


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (a, b))
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(mask) for x in ("x", "y")], ["x", "y"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(v, root) of every end of a link (x, y): the smallest v of its component.

    Labels fall to the smallest among the neighbours, then to their label's
    label, until none changes; each round is written to the shared folder."""
    both = stored(links.select("x", "y").union(links.select("y", "x")).toDF("u", "v").where("u != v").distinct(), "links")
    labels = stored(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("root")), "roots")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "root"), "u").groupBy("v").agg(F.min("root").alias("near"))
        lower = labels.select("v", "root").join(near, "v").select("v", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = lower.select(F.col("v").alias("root"), F.col("root").alias("next"))
        new = stored(lower.join(jump, "root", "left").select("v", F.least(F.col("root"), F.coalesce("next", "root")).alias("root"), "was"), "roots")
        discard(labels)
        if not new.where("root != was").limit(1).count():
            discard(both)
            return new.select("v", "root")
        labels = new


def _links(texts: DataFrame, k: int, percent: int, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: id, tie, key, n; classes: key, first, copies; links between set keys).  texts: id, tie, text."""
    signed = stored(texts.mapInArrow(_signed(k), SIGNED), "join_signed")
    rows = signed.where(F.col("block").isNull())
    known = rows.select("id", "tie", "key", "n")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie")).alias("first")
    classes = stored(rows.where("key != 0").groupBy("key").agg(first, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bits").alias("bits")), "join_classes")
    sketch = texts.sparkSession.sparkContext.broadcast(sketch_of(signed.where(F.col("block").isNotNull()).select("block", "counts")))
    tokens = texts.select("text").mapInArrow(_prefixes(k, percent, sketch), PREFIXED)
    met = stored(tokens.repartition(F.col("token"), F.col("part")).sortWithinPartitions("token", "part", "key").mapInArrow(_met(percent), MET), "join_met")
    rare = met.where(F.col("x").isNotNull()).groupBy("x", "y").agg(F.count("*").alias("found"), F.min("ask").alias("ask")).where("found >= ask").select("x", "y")

    fields = ["keys", "sizes", "counts", "before"]
    chunks = met.where(F.col("token").isNotNull()).select("token", "chunk", *fields)
    none = [F.lit(None).cast("long").alias("chunk2"), *(F.lit(None).cast("binary").alias(f + "2") for f in fields)]
    names = chunks.select("token", "chunk")  # which chunks meet is found without what they hold
    two = names.join(names.where("chunk > 0").withColumnRenamed("chunk", "chunk2"), "token").where("chunk < chunk2")
    two = two.join(chunks, ["token", "chunk"]).join(chunks.select("token", F.col("chunk").alias("chunk2"), *(F.col(f).alias(f + "2") for f in fields)), ["token", "chunk2"])
    wide = chunks.select("*", *none).unionByName(two).repartition(F.col("token"), F.col("chunk"), F.col("chunk2"))
    planned = stored(wide.mapInArrow(_planned(percent), PLANNED), "join_planned")
    pairs = rare.union(planned.where(F.col("x").isNotNull()).select("x", "y")).distinct()
    pairs = pairs.join(classes.select(F.col("key").alias("x"), F.col("n").alias("a"), F.col("bits").alias("p")), "x").join(classes.select(F.col("key").alias("y"), F.col("n").alias("b"), F.col("bits").alias("q")), "y")
    pairs = stored(pairs.mapInArrow(_likely(percent), "x long, y long, size long"), "join_pairs")
    discard(met)
    members = planned.where(F.col("key").isNotNull()).drop("x", "y")

    keys = pairs.select("x").union(pairs.select("y")).union(members.select("key")).toDF("key").distinct()
    wanted = classes.join(keys, "key").select(F.col("first.id").alias("id"), F.col("first.tie").alias("tie"))
    passes = texts.sparkSession.sparkContext.broadcast(filter_of(wanted))
    sets = stored(texts.select(_place().alias("place"), "text").mapInArrow(_whole_sets(k, passes), "key long, items binary").dropDuplicates(["key"]), "join_sets")
    links = _verified_links(pairs, members, sets, percent, every)
    for done in (planned, pairs, sets):
        discard(done)
    return known, classes.select("key", "first", "copies"), reduce(DataFrame.union, links)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"), "text")


def report(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs."""
    found = _components_of(docs, k, percent)
    component = F.when(F.col("key") == 0, F.col("id")).otherwise(F.col("component.id"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def joined(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, class_id (the smallest id with the same set), n_links (other documents
    that it is linked with): one row for each row of docs.  Makes a row for each pair
    of linked classes, as many as there are links."""
    known, classes, links = _links(_texts(docs), k, percent, every=True)
    links = links.select("x", "y").union(links.select("y", "x")).toDF("x", "y").where("x != y").distinct()
    n = links.join(classes.select(F.col("key").alias("y"), "copies"), "y").groupBy("x").agg(F.sum("copies").alias("n")).withColumnRenamed("x", "key")
    named = classes.join(n, "key", "left").select("key", "copies", F.col("first.id").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = _to_classes(known, stored(named, "join_counted"))
    empty = F.col("key") == 0
    return out.select(F.col("id").alias("doc_id"), F.when(empty, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def _to_classes(known: DataFrame, named: DataFrame) -> DataFrame:
    """known with the columns of named (a stored table: key, copies, ...), null for the
    empty set.  Classes of over a HOT_SHARE-th of all rows, fewer than HOT_SHARE, are
    broadcast, and their rows are not shuffled by key."""
    total = named.agg(F.sum("copies")).first()[0] or 0
    values = [F.col(c) for c in named.columns if c not in ("key", "copies")]
    hot = named.where(F.col("copies") > total / HOT_SHARE).select(F.col("key").alias("hot"), F.struct(*values).alias("of_hot"))
    cold = named.where(F.col("copies") <= total / HOT_SHARE).select(F.col("key").alias("cold"), F.lit(False).alias("apart"), F.struct(*values).alias("of_cold"))
    rows = known.join(F.broadcast(hot), F.col("key") == F.col("hot"), "left")
    aside = F.col("hot").isNotNull() | (F.col("key") == 0)
    rows = rows.withColumn("aside", aside).withColumn("route", F.when(aside, F.xxhash64("id", "tie")).otherwise(F.col("key")))
    out = rows.join(cold, (F.col("route") == F.col("cold")) & (F.col("aside") == F.col("apart")), "left")
    return out.select(*known.columns, F.coalesce("of_hot", "of_cold").alias("of")).select(*known.columns, "of.*")


def _components_of(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, tie, key, n, component: none, id, tie of its first document) of each row of docs."""
    known, classes, links = _links(_texts(docs), k, percent)
    roots = components(links).toDF("key", "root")
    classes = classes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = classes.groupBy("root").agg(F.min("first").alias("component"))
    return _to_classes(known, stored(classes.join(names, "root").select("key", "copies", "component"), "join_named"))


#: What becomes of a document, as far as its place tells.
STAYS, GOES, UNSURE = 0, 1, 2


def _fates(decided: DataFrame):
    """A function of places: a place goes if all its documents (decided: id, tie, goes, times) go, and is unsure if
    only some do, or if one that stays is repeated.  What is sent does not grow with the corpus."""
    told = (F.col("goes") == 1) | (F.col("times") > 1)
    at = stored(decided.groupBy(_place().alias("place")).agg(F.min("goes").alias("all"), F.max(told).alias("some")), "join_places")
    bits = [_bits(at.where(c).select("place")) for c in ("all = 1", "all = 0 AND some")]
    sent = decided.sparkSession.sparkContext.broadcast(bits)
    discard(at)

    @F.pandas_udf("int")
    def fate(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
        gone, unsure = sent.value
        for p in places:
            yield pd.Series(np.where(_within(gone, p.to_numpy()), GOES, np.where(_within(unsure, p.to_numpy()), UNSURE, STAYS)).astype(np.int32))

    return fate


def first_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs, of each component only the document of smallest id (without ids, and among
    texts of one id, of smallest text hash); of repeated rows of it one stays, and rows
    without words all stay.

    Texts are not shuffled, but for the few whose place in a filter of fixed size is
    that of documents that go and of others that stay."""
    found = _components_of(docs, k, percent)
    first = F.struct(F.col("id").isNull().alias("none"), "id", "tie")
    goes = (F.col("key") != 0) & (first != F.col("component"))
    decided = found.groupBy("id", "tie").agg(F.min(F.when(goes, 1).otherwise(0)).alias("goes"), F.count_if(F.col("key") != 0).alias("times"))
    decided = stored(decided, "join_decided")
    fate = _fates(decided)
    box = fresh(docs, "decided")
    tied = docs.withColumn(box, F.struct(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie")))
    seen = tied.withColumn(box + "f", fate(_place(box + ".")))
    sure = seen.where(F.col(box + "f") == STAYS).drop(box, box + "f")
    rows = decided.where("goes = 1 OR times > 1")
    named = rows.select(F.struct(F.col("id").alias("id"), F.col("tie").alias("tie"), "goes").alias(box + "r"))
    match = F.col(f"{box}.id").eqNullSafe(F.col(f"{box}r.id")) & (F.col(f"{box}.tie") == F.col(f"{box}r.tie"))
    found = seen.where(F.col(box + "f") == UNSURE).drop(box + "f").join(named, match, "left").where(F.coalesce(F.col(f"{box}r.goes"), F.lit(0)) == 0)
    found = stored(found, "join_unsure")
    single = found.where(F.col(f"{box}r").isNull()).drop(box, box + "r")
    again = found.where(F.col(f"{box}r").isNotNull()).dropDuplicates([box]).drop(box, box + "r")
    return sure.union(single).union(again)


def report_sql(k: int = SHINGLE, percent: int = PERCENT) -> str:
    """``report`` in DuckDB SQL, for tables of unique ids."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(1, len(w) - {k - 1}) + 1)) AS p FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT p.doc_id, array_to_string(w[p.p : p.p + {k - 1}], ' ') AS s FROM p JOIN w ON p.doc_id = w.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= {percent} * (a.n + b.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON w.doc_id = r.x"""
