"""Substring dedup by suffix automata of reference shards.

A word goes when a window of ``min_words`` words that covers it also starts
earlier: in a document of smaller id, or in the same one at an earlier start.

The corpus' automata together grow with the corpus, so they are not broadcast as
a whole.  Each window names a shard by content: its anchor, the smallest hash
among its word 5-grams, which equal windows share.  A document falls into
segments, runs of windows with one anchor (at most 16 windows), and only the
segments of one anchor are compared:

1. Each task collapses the segments of equal words that it reads together; all
   but the first of them are repeats.
2. What is left meets by anchor, in order of words and place.  Of equal segments
   the first leads and the others are repeats; leads of an anchor with other
   leads are contested.  Anchors with over a HOT_SHARE-th of the segments of a
   sample of documents, fewer than HOT_SHARE, are dealt over SALTS tasks by their
   segments' words, and all their leads count as contested: the sample decides
   where segments meet, not what is found.
3. The contested leads' words, in order of place, are streamed against the
   suffix automaton of their shard, which grows by each of them: matching
   statistics of ``min_words`` or more are windows that started earlier.
   An anchor with over HOT leads (a frequent word n-gram) is split into shards of
   one window's words each, of which no automaton is needed: the first place of
   each is found by partial aggregates.
4. The repeats' spans meet their documents by id, and their words are cut out.

Cases: null and empty texts have no words; texts under ``min_words`` words are
never cut; rows that repeat an id and its text count as one document, and each
gets its result; different texts under one id are ordered by a hash of the text;
null ids count as smallest; an empty table gives an empty result; other columns
are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from netloom.llm import textops as T
from netloom.functions.store import discard, stored

MIN_WORDS = 20
ANCHOR = 5
#: An anchor with more contested segments than this is split into windows.
HOT = 256
HOT_SHARE = 5_000
SALTS = 64
#: One in so many documents is sampled for hot anchors, and the least segments of one there.
SAMPLE, SAMPLE_LEAST = 16, 64

SEGMENT = "a long, salt int, sh long, id long, tie int, pos int, n int"
MARK = "kind int, a long, id long, tie int, pos int, n int"
REPEAT, CONTESTED, KEEP = range(3)


class SuffixAutomaton:
    """The substrings of a set of word sequences, for matching statistics."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list) -> None:
        """Extends the automaton by a sequence of its own (Blumer et al., generalised)."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            at = nxt[last].get(c)
            if at is not None and length[at] == length[last] + 1:
                last = at
                continue
            cur = -1
            if at is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    target = q
                else:
                    target = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = target
                        p = link[p]
                    link[q] = target
                if cur >= 0:
                    link[cur] = target
                else:
                    cur = target
            last = cur

    def matches(self, sequence: list) -> list[int]:
        """The longest match that ends at each place of the sequence."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(c)
            if to is None:
                matched = 0
            else:
                state = to
                matched += 1
            out.append(matched)
        return out


def segments(w: T.Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor hash, content hash) of a chunk's segments."""
    none = np.zeros(0, np.int64)
    g, whole = T.grams(w.hash, ANCHOR), T.grams(w.hash, k)
    n = len(whole)
    valid = w.left()[:n] >= k
    if not valid.any():
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    low, at, span = g, np.arange(len(g)), 1
    while span < k - ANCHOR + 1:  # the leftmost smallest of the window's n-grams, by doubling
        step = min(span, k - ANCHOR + 1 - span)
        m = len(low) - step
        right = low[step:] < low[:m]
        low = np.where(right, low[step:], low[:m])
        at = np.where(right, at[step:], at[:m])
        span += step
    at = at[:n]
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(begins)
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | begins[1:]
    last = np.flatnonzero(ends)
    size, offset = last - first + 1, at[first] - first
    content = T.mix(T.mix(whole[first] + size.astype(np.uint64)) * np.uint64(3) + whole[last] + offset.astype(np.uint64))
    return first, size, g[at[first]], content


def _spans(starts: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins runs that follow one another in a group; input in order of (group, start)."""
    if not len(starts):
        return starts, sizes, group
    ends = starts + sizes
    new = np.ones(len(starts), bool)
    new[1:] = (group[1:] != group[:-1]) | (starts[1:] != ends[:-1])
    at = np.flatnonzero(new)
    return starts[at], np.append(ends[at[1:] - 1], ends[-1]) - starts[at], group[at]


def _anchors(k: int):
    """(anchor, its segments in a batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in T.chunks(batch.column("text")):
                a, n = np.unique(segments(T.words(c), k)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], ["a", "n"])

    return run


def hot_anchors(texts: DataFrame, k: int) -> np.ndarray:
    """The sorted hashes of the hot anchors of a sample of documents, at most HOT_SHARE."""
    some = texts.where(F.pmod(F.xxhash64("id", "tie"), F.lit(SAMPLE)) == 0).select("text")
    counts = stored(some.mapInArrow(_anchors(k), "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") > 1), "segments_sampled")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") > max(SAMPLE_LEAST, total // HOT_SHARE)).select("a").collect()  # fewer than HOT_SHARE
    discard(counts)
    return np.sort(np.array([r["a"] for r in rows], np.int64))


def _local(k: int, sent):
    """Step 1: the segments that are left, and as rows of negative n the spans of repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = (batch.column(x).to_numpy() for x in ("id", "tie"))
            found = []
            for c in T.chunks(batch.column("text")):
                w = T.words(c)
                first, size, anchor, content = segments(w, k)
                doc = w.doc[first]
                found.append((anchor, content, doc + c.row0, first - w.doc_word[doc], size))
            if not found:
                continue
            anchor, content, row, pos, size = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((pos, ties[row], ids[row], content))
            h, r, p = content[order], row[order], pos[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            same = (ids[r] == ids[r[lead]]) & (ties[r] == ties[r[lead]]) & (p == p[lead])  # a repeated row
            gone = np.sort(order[~same])  # in order of row and place
            start, n, of = _spans(pos[gone], size[gone], row[gone])
            at = order[new]
            route = T.mix(ids[of].view(np.uint64) + np.uint64(1)).view(np.int64)
            salt = np.where(np.isin(anchor[at].view(np.int64), sent.value), 1 + (content[at] % np.uint64(SALTS)).astype(np.int64), 0)
            cols = (
                np.concatenate([anchor[at].view(np.int64), route]), np.concatenate([salt, np.zeros(len(of), np.int64)]).astype(np.int32), np.concatenate([content[at].view(np.int64), np.zeros(len(of), np.int64)]),
                ids[np.concatenate([row[at], of])], ties[np.concatenate([row[at], of])],
                np.concatenate([pos[at], start]).astype(np.int32), np.concatenate([size[at], -n]).astype(np.int32),
            )
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["a", "salt", "sh", "id", "tie", "pos", "n"])

    return run


def _marks(kind: int | np.ndarray, a, ids, ties, pos, n) -> pa.RecordBatch:
    kind = np.full(len(ids), kind, np.int32)
    cols = (kind, a, ids, ties, np.asarray(pos, np.int32), np.asarray(n, np.int32))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["kind", "a", "id", "tie", "pos", "n"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, over rows in order of (a, salt, sh, id, tie, pos)."""
    names = ("a", "salt", "sh", "id", "tie", "pos", "n")
    lead: tuple | None = None  # of the last run
    told = True  # whether that lead is known to be contested and given
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(x).to_numpy() for x in names]
        if (cols[6] < 0).any():
            known = cols[6] < 0
            yield _marks(REPEAT, *(c[known] for c in (cols[0], *cols[3:6])), -cols[6][known])
            cols = [c[~known] for c in cols]
            if not len(cols[0]):
                continue
        if lead is not None:  # in front of the others, as if it were the batch's first row
            cols = [np.concatenate([np.array([x], c.dtype), c]) for x, c in zip(lead, cols, strict=True)]
        a, salt, sh, ids, ties, pos, n = cols
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (sh[1:] != sh[:-1])
        runs = np.flatnonzero(new)
        of = runs[np.cumsum(new) - 1]
        repeat = np.flatnonzero((ids != ids[of]) | (ties != ties[of]) | (pos != pos[of]))
        near = a[runs[1:]] == a[runs[:-1]]
        contested = salt[runs] > 0  # segments of other words may have met elsewhere
        contested[1:] |= near
        contested[:-1] |= near
        give = contested.copy()
        if lead is not None and told:
            give[0] = False
            contested[0] = True
        told, lead = bool(contested[-1]), tuple(c[runs[-1]] for c in cols)
        at = np.concatenate([repeat, runs[give]])
        kind = np.repeat(np.array([REPEAT, CONTESTED], np.int32), [len(repeat), int(give.sum())])
        yield _marks(kind, a[at], ids[at], ties[at], pos[at], n[at])


def _words_of(k: int):
    """The words of contested segments: whole ones, or each window by itself where the anchor is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            ids, ties, asked = batch.column("id").to_pylist(), batch.column("tie").to_pylist(), batch.column("asked")
            for c in T.chunks(batch.column("text")):
                w = T.words(c)
                whole = T.grams(w.hash, k).view(np.int64)
                h = w.hash.astype(np.uint32)
                for i in range(c.n):
                    base = int(w.doc_word[i])
                    for x in asked[c.row0 + i].as_py():
                        s = base + x["pos"]
                        if x["hot"]:
                            rows = [(int(whole[s + j]), x["pos"] + j, 1, b"") for j in range(x["n"])]
                        else:
                            rows = [(x["a"], x["pos"], x["n"], h[s : s + x["n"] + k - 1].tobytes())]
                        for route, pos, n, words in rows:
                            for o, v in zip(out, (route, ids[c.row0 + i], ties[c.row0 + i], pos, n, words), strict=True):
                                o.append(v)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["a", "id", "tie", "pos", "n", "words"])

    return run


def _stream(k: int):
    """Step 3, over segments in order of (a, id, tie, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = last = None
        automaton = SuffixAutomaton()
        for batch in batches:
            ids, ties, starts, sizes = [], [], [], []
            for a, i, t, pos, words in zip(*(batch.column(x).to_pylist() for x in ("a", "id", "tie", "pos", "words")), strict=True):
                if (a, i, t, pos) == last:  # a repeated row
                    continue
                last = a, i, t, pos
                if a != shard:
                    shard, automaton = a, SuffixAutomaton()
                sequence = np.frombuffer(words, np.uint32).tolist()
                seen = [m >= k for m in automaton.matches(sequence)[k - 1 :]]
                if not all(seen):
                    automaton.add(sequence)
                begin = None
                for j, hit in enumerate([*seen, False]):
                    if hit and begin is None:
                        begin = j
                    elif not hit and begin is not None:
                        ids.append(i)
                        ties.append(t)
                        starts.append(pos + begin)
                        sizes.append(j - begin)
                        begin = None
            yield _marks(REPEAT, np.zeros(len(ids), np.int64), np.array(ids, np.int64), np.array(ties, np.int32), starts, sizes)

    return run


def _marked(docs: DataFrame, k: int) -> DataFrame:
    """(row: all columns of docs, marks: array of (kind, pos, n) or null)."""
    text = F.col("text")
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.coalesce(F.xxhash64(text).bitwiseAND(0x7FFFFFFF).cast("int"), F.lit(0)).alias("tie"),
    )
    texts = keyed.select("id", "tie", F.col("row.text").alias("text")).where(F.col("text").isNotNull())
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(texts, k))
    local = texts.mapInArrow(_local(k, hot), SEGMENT)
    met = stored(local.repartition(F.col("a"), F.col("salt")).sortWithinPartitions("a", "salt", "sh", "id", "tie", "pos").mapInArrow(_meet, MARK), "segments_met")
    repeats, contested = met.where(F.col("kind") == REPEAT), met.where(F.col("kind") == CONTESTED)
    hot = contested.groupBy("a").count().where(F.col("count") > HOT).select("a", F.lit(True).alias("hot"))
    hot = stored(hot, "segments_hot")  # else the leads of a frequent anchor would meet in a task
    contested = contested.join(hot, "a", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    asked = contested.groupBy("id", "tie").agg(F.collect_list(F.struct("a", "pos", "n", "hot")).alias("asked"))
    sent = texts.join(asked, ["id", "tie"]).select("id", "tie", "text", "asked").mapInArrow(_words_of(k), "a long, id long, tie int, pos int, n int, words binary")
    sent = stored(sent, "segments_contested")
    whole = sent.where(F.length("words") > 0)
    streamed = whole.repartition(F.col("a")).sortWithinPartitions("a", "id", "tie", "pos").mapInArrow(_stream(k), MARK)
    windows = sent.where(F.length("words") == 0)
    firsts = windows.groupBy("a").agg(F.min(F.struct("id", "tie", "pos")).alias("x")).select(F.lit(KEEP).alias("kind"), "a", "x.id", "x.tie", "x.pos", F.lit(1).alias("n"))
    split = contested.where("hot").select(F.lit(REPEAT).alias("kind"), "a", "id", "tie", "pos", "n")
    marks = repeats.unionByName(streamed).unionByName(split).unionByName(firsts)
    marks = marks.groupBy("id", "tie").agg(F.collect_list(F.struct("kind", "pos", "n")).alias("marks"))
    return keyed.join(marks, ["id", "tie"], "left").select("row", "marks")


def _removed(marks, n_words: int, k: int) -> np.ndarray | None:
    """True at each word that goes."""
    if not marks:
        return None
    m = np.array([(x["kind"], x["pos"], x["n"]) for x in marks], np.int64)
    gone, keep = m[m[:, 0] == REPEAT], m[m[:, 0] == KEEP]
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, gone[:, 1], 1)
    np.add.at(edge, gone[:, 1] + gone[:, 2], -1)
    window = np.cumsum(edge[:-1]) > 0
    window[keep[:, 1]] = False
    start = np.flatnonzero(window)
    edge[:] = 0
    np.add.at(edge, start, 1)
    np.add.at(edge, start + k, -1)
    return np.cumsum(edge[:-1]) > 0


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            count, gone, digest = [], [], []
            for text, marks in zip(row.field("text"), batch.column("marks"), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                removed = _removed(marks.as_py(), len(words), min_words)
                count.append(len(words))
                gone.append(0 if removed is None else int(removed.sum()))
                kept = words if removed is None else compress(words, (~removed).tolist())
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([row.field("doc_id"), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_words).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def removed(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the repeated words, and the white space after each, cut out of
    the texts; n_chars, where there is one, counts what is left of a cut text."""
    schema = S.StructType([*docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            cols = dict(zip(schema.names, row.flatten(), strict=True))
            marks = batch.column("marks").to_pylist()
            texts = cols["text"].to_pylist()
            sizes = cols["n_chars"].to_pylist() if "n_chars" in cols else None
            for c in T.chunks(cols["text"]):
                if not any(marks[c.row0 : c.row0 + c.n]):
                    continue
                w = T.words(c, hashed=False)
                for i in range(c.n):
                    lo, hi = int(w.doc_word[i]), int(w.doc_word[i + 1])
                    gone = _removed(marks[c.row0 + i], hi - lo, min_words)
                    if gone is None or not gone.any():
                        continue
                    begin, end = int(c.doc_start[i]), int(c.doc_start[i + 1])
                    until = np.append(w.start[lo + 1 : hi], end)
                    edge = np.zeros(end - begin + 1, np.int64)
                    np.add.at(edge, w.start[lo:hi][gone] - begin, 1)
                    np.add.at(edge, until[gone] - begin, -1)
                    left = c.buf[begin:end][np.cumsum(edge[:-1]) == 0].tobytes().decode("utf-8", "surrogatepass")
                    texts[c.row0 + i] = left
                    if sizes:
                        sizes[c.row0 + i] = len(left)
            cols["text"] = pa.array(texts, cols["text"].type)
            if sizes:
                cols["n_chars"] = pa.array(sizes, cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return _marked(docs, min_words).mapInArrow(run, schema)


def report_sql(min_words: int = MIN_WORDS) -> str:
    """``report`` in DuckDB SQL, for tables of unique ids."""
    k = min_words
    return rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - {k - 2})) AS p FROM d WHERE len(w) >= {k}),
k AS (SELECT p.doc_id, p.p, array_to_string(w[p.p : p.p + {k - 1}], ' ') AS words FROM p JOIN d ON p.doc_id = d.doc_id),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY words ORDER BY doc_id, p) AS n FROM k) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {k})) AS i FROM again),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS text FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id"""
