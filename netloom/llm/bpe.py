"""Byte-level BPE encoding and decoding through a pair occurrence index.

A task reads its documents in groups, cuts them into pre-tokens without a Python
loop, and keeps each distinct pre-token once.  The symbols of all distinct
pre-tokens form one linked list.  An index maps each mergeable pair to all its
positions; active ranks are applied in ascending order, each to every position
at once, and the lists of the pairs that a merge makes are updated.  Ascending
order gives the same ids as merging the lowest rank first in each word, as every
merge joins tokens of earlier merges (``Codec.load`` verifies that).

The vocabulary's arrays are of fixed size and are broadcast.

Cases: null and empty texts have no ids; the special token's own string in a
text becomes its id; repeated rows are encoded alike; very long texts are
encoded whole; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as S

from netloom.llm import textops as T

#: Text that shares one pair index, and distinct pre-tokens kept between groups.
GROUP_BYTES = 8 << 20
KEPT_TOKENS = 1 << 19

#: Options of a BPE model that change its ids; only their absence is followed.
MODEL_OPTIONS = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")

OTHER, LETTER, NUMBER, SPACE = range(4)
_kinds: np.ndarray | None = None


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def char_kinds() -> np.ndarray:
    """The kind of every code point: letter, number, white space or other."""
    global _kinds
    if _kinds is None:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        kinds = np.zeros(len(every), np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                kinds[m.start() : m.end()] = kind
        _kinds = np.concatenate([kinds[:0xD800], np.zeros(0x800, np.uint8), kinds[0xD800:]])
    return _kinds


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the other bytes for 256, 257, ..."""
    own = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    rest = [x for x in range(256) if x not in set(own)]
    return {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(rest)}


@dataclass
class Codec:
    byte_id: np.ndarray  # int32[256]: ids of the single bytes
    pair: np.ndarray  # int64, sorted: left id << 32 | right id
    rank: np.ndarray  # of each pair
    left: np.ndarray  # by rank
    right: np.ndarray
    made: np.ndarray
    token: list[bytes]  # bytes of each id
    special: list[tuple[bytes, int]]

    @staticmethod
    def load(path: str) -> Codec:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        if d["model"]["type"] != "BPE" or d["pre_tokenizer"]["type"] != "ByteLevel" or d["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE tokenizer without prefix space is needed")
        odd = [f"model.{x}" for x in MODEL_OPTIONS if d["model"].get(x)] + [x for x in ("normalizer", "post_processor") if d.get(x)]
        odd += ["pre_tokenizer.use_regex"] * (not d["pre_tokenizer"].get("use_regex", True)) + ["decoder"] * ((d.get("decoder") or {}).get("type") != "ByteLevel")
        odd += [f"added_tokens.{x}" for t in d["added_tokens"] for x in ("single_word", "lstrip", "rstrip", "normalized") if t.get(x)]
        if odd:
            raise ValueError(f"settings that this codec does not follow: {', '.join(odd)}")
        vocab, symbols = d["model"]["vocab"], byte_symbols()
        merges = [m if isinstance(m, list) else m.split(" ") for m in d["model"]["merges"]]
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        born = np.full(max(vocab.values()) + 1, -1)
        born[made[::-1]] = np.arange(len(made))[::-1]
        if (born[left] >= np.arange(len(made))).any() or (born[right] >= np.arange(len(made))).any():
            raise ValueError("a merge joins a token that only a later merge makes")
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        special = [(t["content"].encode(), t["id"]) for t in d["added_tokens"]]
        token = [b""] * (1 + max([*vocab.values(), *(i for _, i in special)]))
        for t, i in [*vocab.items(), *((s.decode(), i) for s, i in special)]:
            token[i] = bytes(symbols[c] for c in t) if all(c in symbols for c in t) else t.encode()
        byte_id = np.zeros(256, np.int32)
        for c, x in symbols.items():
            byte_id[x] = vocab[c]
        return Codec(byte_id, key[order], order, left.astype(np.int32), right.astype(np.int32), made.astype(np.int32), token, special)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it never merges."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], -1)

    def merged(self, buf: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens whose bytes lie one after another in buf, and their number for each."""
        n = len(buf)
        sym = self.byte_id[buf]
        ends = np.cumsum(length)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[ends - 1] = -1
        prv[ends - length] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray, rank: np.ndarray) -> None:
            some = rank >= 0
            if not some.all():
                at, rank = at[some], rank[some]
            if not len(at):
                return
            if len(at) > 1:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            begin = [0, *cut.tolist()]
            for r, i, j in zip(rank[begin].tolist(), begin, [*begin[1:], len(at)], strict=True):
                found = index.get(r)
                if found is None:
                    index[r] = [at[i:j]]
                    heapq.heappush(active, r)
                else:
                    found.append(at[i:j])

        start = np.flatnonzero(nxt >= 0)
        add(start, self.ranks(sym[start], sym[start + 1]))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            p = p[sym[p] == a]
            q = nxt[p]
            ok = (q >= 0) & (sym[q] == b)
            p, q = p[ok], q[ok]
            if a == b and len(p) > 1:  # of overlapping pairs, every other one from the left
                p = np.unique(p)
                q = nxt[p]
                new = np.ones(len(p), bool)
                new[1:] = p[1:] != q[:-1]
                at = np.arange(len(p))
                even = (at - np.maximum.accumulate(np.where(new, at, 0))) % 2 == 0
                p, q = p[even], q[even]
            if not len(p):
                continue
            after, before = nxt[q], prv[p]
            sym[p] = self.made[r]
            sym[q] = -1
            nxt[p] = after
            has = after >= 0
            prv[after[has]] = p[has]
            before = prv[p]
            lhs = np.concatenate([before[before >= 0], p[has]])
            if len(lhs):
                add(lhs, self.ranks(sym[lhs], sym[nxt[lhs]]))
        alive = sym >= 0
        total = np.zeros(n + 1, np.int64)
        np.cumsum(alive, out=total[1:])
        return sym[alive], total[ends] - total[ends - length]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", "replace")


def pretokens(c: T.Chunk, special: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte starts, document bounds as token numbers, special id or -1) of a chunk.

    Rules of the byte-level pattern: the contractions 's 't 're 've 'm 'll 'd,
    runs of letters, numbers or others with one leading space, and white space,
    whose last character is left to what follows.
    """
    raw = c.buf.tobytes()
    points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero((c.buf & 0xC0) != 0x80)
    n = len(points)
    fresh = np.zeros(n + 1, bool)  # a text, or a part beside special tokens, begins
    fresh[np.searchsorted(at, c.doc_start)] = True
    marks = []
    for word, i in special:
        for m in re.finditer(re.escape(word), raw) if word in raw else ():
            d = np.searchsorted(c.doc_start, m.start(), side="right")
            if m.end() <= c.doc_start[d]:
                s, e = np.searchsorted(at, [m.start(), m.end()])
                fresh[s] = fresh[e] = True
                marks.append((s, e, i))
    kind = char_kinds()[points]
    white = kind == SPACE
    prev = np.full(n, 255, np.uint8)
    prev[1:] = kind[:-1]
    prev[fresh[:-1]] = 255
    nxt = np.full(n, 255, np.uint8)
    nxt[:-1] = kind[1:]
    nxt[fresh[1:]] = 255
    after_blank = np.zeros(n, bool)
    after_blank[1:] = points[:-1] == 32
    after_blank &= prev != 255
    run = kind != prev
    start = np.where(white, run | (nxt < SPACE), run & ~after_blank)
    quotes = np.flatnonzero((points == 39) & start & (nxt == LETTER))
    if len(quotes):
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        two = np.where((quotes + 2 < n) & ~fresh[np.minimum(quotes + 2, n)], two, 0)
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = np.zeros(len(quotes), bool)
        for x, y in ("re", "ve", "ll"):
            long |= (one == ord(x)) & (two == ord(y))
        start[quotes[short | long] + 1] = False
        end = np.where(short, quotes + 2, quotes + 3)[short | long]
        end = end[end < n]
        start[end[(kind[end] == LETTER) & (prev[end] != 255)]] = True
    ids = None
    for s, e, i in marks:
        start[s:e] = False
        start[s] = True
        ids = np.full(n, -1, np.int32) if ids is None else ids
        ids[s] = i
    first = np.flatnonzero(start)
    return at[first], np.searchsorted(first, np.searchsorted(at, c.doc_start)), np.full(len(first), -1, np.int32) if ids is None else ids[first]


class Encoder:
    """Encodes groups of chunks; keeps the ids of distinct pre-tokens between groups."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of pre-tokens
        self.offset = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encode(self, group: list[T.Chunk]) -> Iterator[np.ndarray]:
        """The ids of each document, in order."""
        if len(self.known) > KEPT_TOKENS:
            self.clear()
        cut, new = [], []
        for c in group:
            start, bounds, special = pretokens(c, self.codec.special)
            length = np.diff(np.append(start, len(c.buf)))
            h = T.span_hash(c.buf, start, length)
            h[special >= 0] = special[special >= 0].astype(np.uint64)
            distinct, first, place = np.unique(h, return_index=True, return_inverse=True)
            cut.append((bounds, distinct, place.astype(np.int32)))
            seen = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
            unknown = first[self.known[seen] != distinct] if len(self.known) else first
            if len(unknown):
                spans = [c.buf[s : s + k] for s, k in zip(start[unknown].tolist(), length[unknown].tolist(), strict=True)]
                new.append((h[unknown], special[unknown], length[unknown], np.concatenate(spans)))
        if new:
            self._learn(*(np.concatenate(x) for x in zip(*new, strict=True)))
        for bounds, distinct, place in cut:
            entry = np.searchsorted(self.known, distinct)[place]
            count, offset = self.count[entry], self.offset[entry]
            total = np.zeros(len(entry) + 1, np.int64)
            np.cumsum(count, out=total[1:])
            flat = self.ids[np.arange(total[-1]) + np.repeat(offset - total[:-1], count)]
            ends = total[bounds]
            yield from (flat[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))

    def _learn(self, h: np.ndarray, special: np.ndarray, length: np.ndarray, buf: np.ndarray) -> None:
        h, first = np.unique(h, return_index=True)
        begin = np.cumsum(length) - length
        keep = np.zeros(len(length), bool)
        keep[first] = True
        buf, order = buf[np.repeat(keep, length)], np.flatnonzero(keep)
        ids, count = self.codec.merged(buf, length[order])
        offset = np.cumsum(count) - count
        where = np.empty(len(length), np.int64)
        where[order] = np.arange(len(order))
        count, offset = count[where[first]], offset[where[first]]
        for i in np.flatnonzero(special[first] >= 0):
            ids, offset[i], count[i] = np.append(ids, special[first[i]]), len(ids), 1
        known = np.concatenate([self.known, h])
        at = np.argsort(known, kind="stable")
        self.offset = np.concatenate([self.offset, offset + len(self.ids)])[at]
        self.count = np.concatenate([self.count, count])[at]
        self.known, self.ids = known[at], np.concatenate([self.ids, ids])


def groups(column: pa.Array) -> Iterator[list[T.Chunk]]:
    group, size = [], 0
    for c in T.chunks(column):
        if group and size + len(c.buf) > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(c)
        size += len(c.buf)
    if group:
        yield group


#: What ``encoded`` can add, and its type.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encoded(docs: DataFrame, path: str, outputs: dict[str, str], text: str = "text") -> DataFrame:
    """docs with a column for each of ``outputs``, its name -> one of OUTPUTS, in place of columns of these names."""
    kept = [c for c in docs.columns if c.lower() not in {x.lower() for x in outputs}]
    sent = docs.sparkSession.sparkContext.broadcast(Codec.load(path))
    makes = {
        "n_tokens": lambda ids, _: len(ids),
        "ids": lambda ids, _: ids,
        "ids_sha256": lambda ids, _: hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
        "decoded": lambda _, decoded: decoded(),
        "decoded_sha256": lambda _, decoded: hashlib.sha256(decoded().encode("utf-8", "surrogatepass")).hexdigest(),
    }
    types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            row = 0
            for group in groups(batch.column(text)):
                made: dict[str, list] = {name: [] for name in outputs}
                n = sum(c.n for c in group)
                for ids in encoder.encode(group):
                    decoded = lambda ids=ids: encoder.codec.decode(ids)
                    for name, kind in outputs.items():
                        made[name].append(makes[kind](ids, decoded))
                rows = batch.slice(row, n)
                row += n
                yield pa.RecordBatch.from_arrays([*(rows.column(x) for x in kept), *(pa.array(made[x], types.get(k, pa.string())) for x, k in outputs.items())], [*kept, *outputs])

    schema = S.StructType([docs.schema[x] for x in kept])
    for name, kind in outputs.items():
        schema = schema.add(name, S.ArrayType(S.IntegerType()) if kind == "ids" else OUTPUTS[kind])
    return docs.mapInArrow(run, schema)


def decoded(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """df with the text of each row's array of ids, in place of a column ``name``; null ids give null, unknown ids fail."""
    kept = [c for c in df.columns if c.lower() != name.lower()]
    sent = df.sparkSession.sparkContext.broadcast(Codec.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if x is None else sent.value.decode(np.array(x, np.int32)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(out, pa.string())], [*kept, name])

    return df.mapInArrow(run, S.StructType([df.schema[x] for x in kept]).add(name, "string"))


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    return encoded(docs.select("doc_id", "text"), path or default_path(), {n: n for n in names}).select("doc_id", *names)
