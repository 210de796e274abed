"""Wrapped notices and whole licence files, as they stand in real trees."""

import textwrap
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from netloom.llm import license_scan
from netloom.llm import textops as T

TEXTS = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in (Path(license_scan.__file__).parent / "licenses").glob("*.txt")}
CODE = "\n\nimport os\n\n\ndef run(path):\n    for name in os.listdir(path):\n        print(name)\n    return path\n" * 12


def scanned(spark, files):
    rows = [(i, p, t) for i, (p, t) in enumerate(files)]
    return [r.license for r in license_scan.scan(spark.createDataFrame(rows, "id long, path string, text string")).orderBy("id").collect()]


def test_wrapped_headers(spark):
    names, files = [], []
    for name, notice in license_scan.TEMPLATES:
        if len(notice.split()) > 15 and name != "BSD-2-Clause":
            for i, (width, mark) in enumerate(((76, "# "), (60, " * "), (40, "// "))):
                names.append(name)
                files.append((f"{len(files)}/{i}.py", "# Copyright 2020 Some Body\n" + textwrap.indent(textwrap.fill(notice, width), mark) + CODE))
    assert scanned(spark, files) == names


def test_real_license_files(spark):
    names = sorted(TEXTS)
    files = [(f"{n}/LICENSE", TEXTS[n]) for n in names] + [(f"{n}/src/x.py", CODE) for n in names]
    assert scanned(spark, files) == names * 2


def test_openings_of_license_files(spark):
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0"]
    assert scanned(spark, [(f"{n}/LICENSE", "\n".join(TEXTS[n].split("\n")[:60])) for n in names]) == names


def test_agpl(spark):
    title = "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n"
    notice = "This work is licensed under the GNU Affero General Public License, version 3."
    assert scanned(spark, [("a/COPYING", title), ("a/b.c", CODE), ("c.py", f"# {notice}\n{CODE}"), ("d/LICENSE", dict(license_scan.full_texts())["AGPL-3.0"])]) == ["AGPL-3.0"] * 4


def test_runs_against_all_runs():
    """The bounds lose no run: every run of lines scored one by one gives the same."""
    rng = np.random.default_rng(5)
    index = license_scan.Index()
    words = " ".join(t for _, t in license_scan.TEMPLATES).split() + ["x", "y", "#"]
    docs = []
    for i in range(40):
        lines = [" ".join(rng.choice(words, rng.integers(0, 6))) for _ in range(8)]
        _, notice = license_scan.TEMPLATES[i % len(license_scan.TEMPLATES)]
        docs.append("\n".join([*lines, *textwrap.wrap(notice, int(rng.integers(20, 60))), *lines[:3]]))
    (c,) = T.chunks(pa.array(docs))
    best, score = index.scan(c, np.zeros(c.n, bool))
    for i, d in enumerate(docs):
        lines = [x for x in d.split("\n") if x.strip("# ")]
        units = [" ".join(lines[a:b]) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1)]
        size = [sum(w.strip("#") != "" for w in u.split()) for u in units]
        units = [u for u, n in zip(units, size, strict=True) if n <= index.run_words or "\n" not in u and u in lines] + ["\n".join(d.split("\n")[: license_scan.HEADER_LINES])]
        (k,) = T.chunks(pa.array(units))
        _, unit, h = license_scan._words(k)
        assert score[i] == pytest.approx(index.cosines(h, unit, k.n).max()) and best[i] >= 0
