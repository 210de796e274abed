"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

A file's own licence is the template of the largest cosine, at least MIN_COSINE,
with one of its lines, with a run of lines of at most twice the words of the
longest template (a wrapped notice), or with the first HEADER_LINES lines
together; for licence files (by name, or the index page of a directory) also
with the whole text.  A licence file whose word pairs are those of a full licence
text (``licenses/``), at the same least cosine, has that licence, whatever notices
it quotes.  Words without a weight in the templates count in the norm with the
largest weight; words of punctuation alone, as comment marks are, don't count.
A file without a licence inherits from its nearest ancestor directory that has a
licence file, by joins of directory paths.

Cases: null and empty texts have no own licence; a null path has no directory
and inherits nothing; ties in cosine go to the licence first in code-point
order; repeated rows are scanned alike; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.store import stored
from netloom.llm import textops as T
from netloom.llm import web
from netloom.operators.joins import by_key

MIN_COSINE = 0.7
HEADER_LINES = 30
#: Words of candidate runs scored at once.
_RUN_WORDS = 1 << 17
#: Room for rounding in bounds of a cosine.
_SLACK = 1e-9
LICENSE_FILE = r"(?i)^(un)?licen[cs]e([.-].*)?$|^copying([.-].*)?$|^copyright([.-].*)?$|^notice([.-].*)?$"

#: Short notices, title lines and opening words of public licences.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def full_texts() -> list[tuple[str, str]]:
    """(licence, full text) of ``licenses/``; that of AGPL-3.0, which the folder lacks, is GPL-3.0's under its own name and date."""
    found = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
    agpl = found["GPL-3.0"]
    for old, new in (("GNU GENERAL", "GNU AFFERO GENERAL"), ("GNU General", "GNU Affero General"), ("29 June", "19 November")):
        agpl = agpl.replace(old, new)
    return [*found.items(), ("AGPL-3.0", agpl)]


def _words(c: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, document, hash) of the words that have more than punctuation."""
    w = T.words(c, lower=True, trim=True)
    solid = np.append(0, np.cumsum(T._SOLID[c.buf]))
    some = solid[w.end] > solid[w.start]
    return w.start[some], w.doc[some], w.hash[some]


def _pairs(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every two words in a row."""
    if len(h) < 2:
        return doc[:0], h[:0]
    same = doc[1:] == doc[:-1]
    return doc[:-1][same], T.grams(h, 2)[same]


class Index:
    """Unit TF-IDF vectors of the templates over the hashes of their words, or pairs of words."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, pairs: bool = False):
        templates = sorted(templates)
        self.names = [n for n, _ in templates]
        (c,) = T.chunks(pa.array([t for _, t in templates]), 1 << 30)
        _, doc, h = _words(c)
        self.run_words = 2 * int(np.bincount(doc).max())
        if pairs:
            doc, h = _pairs(doc, h)
        self.terms, at = np.unique(h, return_inverse=True)
        tf = np.zeros((len(templates), len(self.terms)))
        np.add.at(tf, (doc, at), 1)
        self.idf = np.log((1 + len(templates)) / (1 + (tf > 0).sum(0))) + 1
        self.unknown = float(np.log(1.0 + len(templates)) + 1)
        v = tf * self.idf
        self.vectors = v / np.sqrt((v * v).sum(1))[:, None]

    def cosines(self, h: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
        """[n, templates] of n units of text; unit: that of each word hash, in order."""
        key, tf = np.unique(np.stack([unit.astype(np.uint64), h]), axis=1, return_counts=True) if len(h) else (np.zeros((2, 0), np.uint64), np.zeros(0))
        at = np.minimum(np.searchsorted(self.terms, key[1]), len(self.terms) - 1)
        known = self.terms[at] == key[1]
        weight = tf * np.where(known, self.idf[at], self.unknown)
        of = key[0].astype(np.int64)
        norm = np.sqrt(np.bincount(of, weight * weight, minlength=n))
        dot = np.zeros((n, len(self.names)))
        np.add.at(dot, of[known], weight[known, None] * self.vectors[:, at[known]].T)
        return dot / np.maximum(norm, 1e-12)[:, None]

    def runs(self, h: np.ndarray, line: np.ndarray, doc: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first line, last line, bound) of the runs of two lines or more that may reach MIN_COSINE and their document's score.

        line: that of each word, counted over lines with words; doc: the document of each line.
        A template's product with a run is a difference of prefix sums, and the norm is at least
        that of the run's words taken apart.  The best run begins and ends with a line that
        shares a word with the template."""
        n = len(doc)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = self.terms[at] == h
        weight = np.where(known, self.idf[at], self.unknown)
        size = np.append(0, np.cumsum(np.bincount(line, minlength=n)))
        square = np.append(0, np.cumsum(np.bincount(line, weight * weight, minlength=n)))
        of, at, weight = line[known], at[known], weight[known]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for v in self.vectors:
            part = np.bincount(of, weight * v[at], minlength=n)
            total = np.append(0, np.cumsum(part))
            first = np.flatnonzero(part > 0)
            last = first
            while len(first):
                last = last + 1
                fits = last < n
                fits[fits] = (doc[last[fits]] == doc[first[fits]]) & (size[last[fits] + 1] - size[first[fits]] <= self.run_words)
                first, last = first[fits], last[fits]
                bound = (total[last + 1] - total[first]) / np.sqrt(square[last + 1] - square[first])
                use = (part[last] > 0) & (bound >= np.maximum(MIN_COSINE, score[doc[first]]) - _SLACK)
                found.append((first[use], last[use], bound[use]))
        first, last, bound = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-bound, last, first))
        first, last, bound = first[order], last[order], bound[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
        return first[new], last[new], bound[new]

    def scan(self, c: T.Chunk, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template, cosine) of each document, -1 below MIN_COSINE.  whole: documents that also count as one unit."""
        start, doc, h = _words(c)
        best, score = np.full(c.n, -1), np.zeros(c.n)
        if not len(h):
            return best, score

        def keep(docs: np.ndarray, cos: np.ndarray) -> None:
            top = cos.argmax(1)
            value = np.round(cos[np.arange(len(docs)), top], 12)
            for d, t, v in zip(docs.tolist(), top.tolist(), value.tolist(), strict=True):
                if v >= MIN_COSINE and (v > score[d] or v == score[d] and self.names[t] < self.names[best[d]]):
                    best[d], score[d] = t, v

        ends = np.flatnonzero(c.buf == 10)
        line = np.searchsorted(ends, start)
        of_line = np.cumsum(np.append(0, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])))
        first = line - np.searchsorted(ends, c.doc_start[:-1])[doc]
        known = np.isin(h, self.terms)
        for unit, use in ((of_line, None), (doc, first < HEADER_LINES), (doc, whole[doc])):
            picked = np.ones(len(h), bool) if use is None else use
            # a unit of few known words can't reach the threshold: its known part bounds the cosine
            n = int(unit[-1]) + 1
            part = np.bincount(unit[picked], np.where(known[picked], 1.0, 0.0), minlength=n)
            rest = np.bincount(unit[picked], minlength=n) - part
            bound = np.array(part > 0)
            bound &= self.unknown**2 * rest * MIN_COSINE**2 <= (1 - MIN_COSINE**2) * (self.idf.max() * part) ** 2
            picked &= bound[unit]
            if not picked.any():
                continue
            ids, place = np.unique(unit[picked], return_inverse=True)
            of = np.zeros(n, np.int64)
            of[unit[picked]] = doc[picked]
            keep(of[ids], self.cosines(h[picked], place, len(ids)))
        at_line = np.flatnonzero(np.append(True, of_line[1:] != of_line[:-1]))
        doc_of_line = doc[at_line]
        at_line = np.append(at_line, len(h))
        lo, hi, bound = self.runs(h, of_line, doc_of_line, score)
        order = np.argsort(-bound, kind="stable")
        while len(order):
            order = order[bound[order] >= score[doc_of_line[lo[order]]] - _SLACK]
            size = at_line[hi[order] + 1] - at_line[lo[order]]
            n = max(1, int(np.searchsorted(np.cumsum(size), _RUN_WORDS, side="right")))
            now, size, order = order[:n], size[:n], order[n:]
            if len(now):
                unit = np.repeat(np.arange(len(now)), size)
                word = np.arange(len(unit)) + np.repeat(at_line[lo[now]] - np.append(0, np.cumsum(size)[:-1]), size)
                keep(doc_of_line[lo[now]], self.cosines(h[word], unit, len(now)))
        return best, score

    def whole(self, c: T.Chunk, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template, cosine) of the word pairs of each document in use, -1 below MIN_COSINE."""
        _, doc, h = _words(c)
        of, pair = _pairs(doc[use[doc]], h[use[doc]])
        cos = np.round(self.cosines(pair, of, c.n), 12)
        top = cos.argmax(1)
        value = cos[np.arange(c.n), top]
        return np.where(value >= MIN_COSINE, top, -1), value


def own_licenses(files: DataFrame) -> DataFrame:
    """files (id, path, text) -> id, path, is_license_file, own_license, cosine."""
    sent = files.sparkSession.sparkContext.broadcast((Index(), Index(full_texts(), pairs=True)))
    name = F.substring_index("path", "/", -1)
    flagged = files.select("id", "path", F.coalesce(name.rlike(LICENSE_FILE) | ((name == "") & F.col("path").contains("/")), F.lit(False)).alias("is_license_file"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, texts = sent.value
        for batch in batches:
            whole = batch.column("is_license_file").to_numpy(zero_copy_only=False)
            found, score = [], []
            for c in T.chunks(batch.column("text")):
                files = whole[c.row0 : c.row0 + c.n]
                hits = [(index.names[b], v) if b >= 0 else (None, None) for b, v in zip(*(x.tolist() for x in index.scan(c, files)), strict=True)]
                if files.any():
                    full = zip(*(x.tolist() for x in texts.whole(c, files)), strict=True)
                    hits = [(texts.names[b], v) if b >= 0 else hit for hit, (b, v) in zip(hits, full, strict=True)]
                found += [n for n, _ in hits]
                score += [v for _, v in hits]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("id", "path", "is_license_file")), pa.array(found, pa.string()), pa.array(score, pa.float64())], ["id", "path", "is_license_file", "own_license", "cosine"])

    return flagged.mapInArrow(run, "id long, path string, is_license_file boolean, own_license string, cosine double")


def scan(files: DataFrame) -> DataFrame:
    """id, path, own_license, cosine, inherited_license, inherited_from, license: one row for each row of files (id, path, text)."""
    found = stored(own_licenses(files), "licenses_own")
    parent = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    found = found.withColumn("dir", parent)
    best = F.min(F.struct(-F.col("cosine"), F.col("own_license")))
    owners = found.where("is_license_file AND own_license IS NOT NULL AND dir IS NOT NULL").groupBy("dir").agg(best.alias("b")).select(F.col("dir").alias("ancestor"), F.col("b.own_license").alias("inherited_license"))
    dirs = found.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("ancestor"))
    nearest = by_key(up, stored(owners, "licenses_owners"), "ancestor").groupBy("dir").agg(F.max(F.struct(F.length("ancestor").alias("n"), "ancestor", "inherited_license")).alias("x"))
    nearest = nearest.select("dir", F.col("x.ancestor").alias("inherited_from"), F.col("x.inherited_license").alias("inherited_license"))
    out = by_key(found, stored(nearest, "licenses_nearest"), "dir", "left")
    none = F.col("own_license").isNull()
    return out.select(
        "id", "path", "own_license", F.round("cosine", 9).alias("cosine"), F.when(none, F.col("inherited_license")).alias("inherited_license"),
        F.when(none, F.col("inherited_from")).alias("inherited_from"), F.coalesce("own_license", "inherited_license").alias("license"),
    )


def page_files(pages: DataFrame) -> DataFrame:
    """Pages as files: the path of the address, and the visible text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            text = pa.array([None if p is None else web.visible(p) for p in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("path"), text], ["id", "path", "text"])

    return pages.select(F.col("page_id").cast("long").alias("id"), web.path(F.col("url")).alias("path"), "html").mapInArrow(run, "id long, path string, text string")
