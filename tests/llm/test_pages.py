import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netloom.llm import language_id, license_scan, queries, textops, web
from netloom.functions.store import table
from netloom.operators import joins


def test_visible_text_and_addresses(spark):
    assert web.visible("<p>a&amp;b<script>x<y</script></p><!-- c --><br>d <b>e</b>").split("\n") == ["", "a&b", "", "", "", "d e"]
    rows = [("HTTPS://u@Host.Example.org:80/a//b?x#y",), ("host/c",), (None,), ("",)]
    got = spark.createDataFrame(rows, "url string").select(web.host(F.col("url")), web.path(F.col("url"))).collect()
    assert got[0][0] == "host.example.org" and got[0][1].endswith("/a/b") and got[2] == ("", None) and got[1] == ("", "host/c")


def test_language_of_pages(spark):
    d = "/root/testdata/sf0.1"
    rows = queries.op7_language_id(spark, d).collect()
    truth = {r.page_id: r.u for r in table(spark, d, "pages").select("page_id", F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("u")).collect()}
    assert len(rows) == len(truth) and sum(r.lang == truth[r.page_id] for r in rows) >= 0.98 * len(rows)
    assert all(0 < r.probability <= 1 for r in rows)


def fused(pages, k, base_weight=(language_id.HOST_WEIGHT, language_id.DOMAIN_WEIGHT, language_id.KEY_WEIGHT)):
    """Plain-Python fusion over (host, declared, text log-likelihoods)."""
    wh, wd, wk = base_weight
    post = []
    for _, _, t in pages:
        e = [math.exp(x - max(t)) for x in t]
        post.append([x / sum(e) for x in e])
    sums = collections.defaultdict(lambda: [0.0] * k)
    domain = lambda h: ".".join(h.split(".")[-2:])
    keys = lambda h, m: (("h", h), ("d", domain(h)), ("s", h.split(".")[-1]), ("m", m), ("a",))
    for (h, m, _), p in zip(pages, post, strict=True):
        for key in keys(h, m):
            sums[key] = [a + b for a, b in zip(sums[key], p, strict=True)]
    n = sum(sums[("a",)])
    base = [(x + 1) / (n + k) for x in sums[("a",)]]
    out = []
    for (h, m, t), p in zip(pages, post, strict=True):
        logs = []
        for j in range(k):
            left = lambda key, j=j, p=p: max(0.0, sums[key][j] - p[j])
            hk, dk, sk, mk, ak = keys(h, m)
            dom = (left(dk) + wd * base[j]) / (sum(sums[dk]) - 1 + wd)
            prior = (left(hk) + wh * dom) / (sum(sums[hk]) - 1 + wh)
            own = sums[ak][j] - p[j] + wk
            logs.append(t[j] + math.log(prior) + sum(math.log((left(x) + wk * sum(sums[x]) / max(n, 1)) / own) for x in (sk, mk)))
        e = [math.exp(x - max(logs)) for x in logs]
        out.append(max((x / sum(e), -j) for j, x in enumerate(e)))
    return out


@pytest.mark.parametrize("broadcast", [joins.MAX_BROADCAST_KEYS, 0])
def test_fusion_against_plain_python(spark, monkeypatch, broadcast):
    monkeypatch.setattr(joins, "MAX_BROADCAST_KEYS", broadcast)
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "de"), (4, "x", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.languages == ["en", "fr"]
    hosts = ["a.x.org", "b.x.org", "b.x.org", "c.y.fr", "c.y.fr", ""]
    htmls = ['<html lang="en"><p>the dog', "<p>le chien", None, '<html lang="fr"><p>cat', '<html lang="fr-CA">', "<p>et"]
    pages = spark.createDataFrame([(i, f"http://{h}/p" if h else None, x, h) for i, (h, x) in enumerate(zip(hosts, htmls, strict=True))], "page_id long, url string, html string, host string")
    read = pages.select("page_id", "host", "html").mapInArrow(language_id._read(model), "page_id long, host string, declared string, text array<double>")
    want = fused([(r.host, r.declared, r.text) for r in read.orderBy("page_id").collect()], 2)
    got = language_id.identify(pages, model).orderBy("page_id").collect()
    assert [r.lang for r in got] == [model.languages[-j] for _, j in want]
    assert [r.probability for r in got] == pytest.approx([p for p, _ in want])


def test_fusion_of_many_languages(spark):
    names = [f"l{i:03d}" for i in range(language_id.MAX_LANGUAGES)]
    docs = spark.createDataFrame([(i, f"word{x} {x}{chr(192 + i)}", x) for i, x in enumerate(names)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    rows = [(i, f"http://h{i % 3}.x.org/p" if i % 5 else None, f"<html lang={names[i] if i % 2 else 'q'}><p>word{names[i * 7]} {chr(192 + i * 7)}" if i % 9 else None) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    read = pages.select("page_id", web.host(F.col("url")).alias("host"), "html").mapInArrow(language_id._read(model), "page_id long, host string, declared string, text array<double>")
    want = fused([(r.host, r.declared, r.text) for r in read.orderBy("page_id").collect()], len(names))
    got = language_id.identify(pages, model).orderBy("page_id").collect()
    assert [r.probability for r in got] == pytest.approx([p for p, _ in want])
    assert model.languages == names and [r.lang for r in got if r.page_id % 9] == [names[-j] for i, (_, j) in enumerate(want) if i % 9]


def test_language_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(None, None, None), (1, "http://h", "<p>x"), (1, "http://h", "<p>x")], "page_id long, url string, html string")
    assert [r.lang for r in language_id.identify(pages, language_id.train(docs)).collect()] == [None] * 3
    model = language_id.train(spark.createDataFrame([(1, "abc", "xx")], "doc_id long, text string, lang string"))
    assert [r.lang for r in language_id.identify(pages, model).collect()] == ["xx"] * 3
    assert language_id.identify(pages.limit(0), model).collect() == []


@pytest.mark.parametrize("tasks", [1, 40])
def test_training_sends_one_table_however_many_tasks_count(spark, monkeypatch, tasks):
    texts = [(i, f"{'the cat' if i % 2 else 'le chien'} {chr(97 + i % 26) * 3} {i}", "en" if i % 2 else "fr") for i in range(80)] + [(80, " ", "xx")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    frame, sent = type(docs), []

    def collect(self, f=frame.collect):
        rows = f(self)
        sent.extend(x for r in rows for x in r if isinstance(x, bytes | bytearray))
        return rows

    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols, f=frame.repartition: f(self, tasks, *cols))
    monkeypatch.setattr(frame, "collect", collect)
    model = language_id.train(docs)
    want = np.zeros((1 << language_id.BITS, 3))
    for c in textops.chunks(pa.array([x for _, x, _ in texts])):
        for doc, coord in zip(*language_id._grams(c), strict=True):
            want[coord, ["en", "fr", "xx"].index(texts[c.row0 + doc][2])] += 1
    assert model.languages == ["en", "fr", "xx"] and want[:, :2].any(0).all() and not want[:, 2].any()
    share = (want + language_id.SMOOTH) / (want.sum(0) + language_id.SMOOTH * len(want))
    assert np.array_equal(model.log_likelihood, np.log(share).astype(np.float32))
    assert sum(map(len, sent)) <= 8 * want.size


FILES = [
    (1, "r/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    (2, "r/src/a.py", "import x\n"),
    (3, "r/vendor/COPYING.txt", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (4, "r/vendor/deep/er/b.c", "int main() {}"),
    (5, "r/src/c.py", "# Licensed under the Apache License, Version 2.0.\nimport x"),
    (6, "q/d.py", "nothing"),
    (7, None, "Released under the MIT License."),
    (8, "r/e.py", None),
    (9, "r/f.py", ""),
    (9, "r/f.py", ""),
    (10, "q/g.txt", "some long story of licences and versions\n" * 50 + "Licensed under CC BY-NC 4.0.\nmore"),
    (11, "top.txt", "plain"),
]


@pytest.mark.parametrize("broadcast", [joins.MAX_BROADCAST_KEYS, 0])
def test_licenses(spark, monkeypatch, broadcast):
    monkeypatch.setattr(joins, "MAX_BROADCAST_KEYS", broadcast)
    df = spark.createDataFrame(FILES, "id long, path string, text string")
    got = {r.id: (r.own_license, r.inherited_license, r.inherited_from, r.license) for r in license_scan.scan(df).collect()}
    assert got == {
        1: ("MIT", None, None, "MIT"), 2: (None, "MIT", "r", "MIT"), 3: ("GPL-3.0", None, None, "GPL-3.0"), 4: (None, "GPL-3.0", "r/vendor", "GPL-3.0"), 5: ("Apache-2.0", None, None, "Apache-2.0"),
        6: (None, None, None, None), 7: ("MIT", None, None, "MIT"), 8: (None, "MIT", "r", "MIT"), 9: (None, "MIT", "r", "MIT"), 10: ("CC-BY-NC-4.0", None, None, "CC-BY-NC-4.0"), 11: (None, None, None, None),
    }
    assert license_scan.scan(df).count() == len(FILES)
    assert license_scan.scan(df.limit(0)).collect() == []


def cosine(line):
    """The largest cosine of a line with a template, by dictionaries."""
    import re

    words = lambda t: [x.strip("".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))) or x for x in re.findall(r"[^\x20\x09-\x0D]+", t.lower())]
    bags = [(n, collections.Counter(words(t))) for n, t in sorted(license_scan.TEMPLATES)]
    df = collections.Counter(w for _, b in bags for w in b)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}
    most = math.log(1 + len(bags)) + 1
    v = {w: n * idf.get(w, most) for w, n in collections.Counter(words(line)).items()}
    norm = lambda x: math.sqrt(sum(a * a for a in x.values()))
    best = 0.0
    for _, b in bags:
        u = {w: n * idf[w] for w, n in b.items()}
        best = max(best, sum(v[w] * u[w] for w in v if w in u) / (norm(v) * norm(u) or 1))
    return best


def test_cosine_against_dictionaries(spark):
    lines = ["Released under the MIT License.", "released, under the mit license today", "Licensed under CC BY-NC-SA 4.0", "the the the license", "GNU General Public License version 3", "MIT"]
    df = spark.createDataFrame([(i, None, x) for i, x in enumerate(lines)], "id long, path string, text string")
    for r in license_scan.own_licenses(df).collect():
        want = cosine(lines[r.id])
        assert (r.cosine == pytest.approx(want)) if want >= license_scan.MIN_COSINE else r.cosine is None


def test_every_page_is_scanned(spark, sf_dir):
    rows = queries.op6_license_scan(spark, sf_dir).collect()
    pages = {r.page_id: r.html for r in table(spark, sf_dir, "pages").collect()}
    assert len(rows) == len(pages)
    assert {r.page_id for r in rows if r.own_license} == {i for i, h in pages.items() if "icensed under" in h or "under the MIT" in h}
