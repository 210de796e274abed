import collections

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from netloom.llm import mixing, toxicity
from netloom.functions.store import stored, table
from tests.llm.test_mixing import targets
from tests.llm.test_ngram_join import brute as near_groups
from tests.llm.test_substring_dedup import WORD


def test_each_stage_on_what_its_predecessor_kept(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], sf_dir), f"test_{name}"))
    assert all(f.columns == columns for f in frames[:-1])
    rows = [{r.doc_id: r for r in f.collect()} for f in frames]

    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.remainder(F.col("doc_id"), 5) != 0)
    toxic = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score >= 0.5}
    assert toxic and rows[1] == {i: r for i, r in rows[0].items() if i not in toxic}

    groups = near_groups([(i, r.text) for i, r in rows[1].items()], 5, 80)
    assert rows[2] == {i: r for i, r in rows[1].items() if groups[i][1] == i}

    seen, cut = set(), 0
    for i in sorted(rows[2]):
        w = WORD.findall(rows[2][i].text)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if (window := tuple(w[p : p + 20])) in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(window)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        cut += any(gone)
        assert WORD.findall(rows[3][i].text) == kept and rows[3][i].n_chars == (len(rows[3][i].text) if any(gone) else rows[2][i].n_chars)
    assert cut and set(rows[3]) == set(rows[2])

    sizes = collections.Counter()
    for r in rows[3].values():
        sizes[r.source] += len(WORD.findall(r.text))
    target = targets(dict(sizes))
    con = duckdb.connect()
    want = {}
    for i, r in rows[3].items():
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0.0
        draw = int(con.execute("SELECT md5(?)", [f"mix-1{i}"]).fetchone()[0][:8], 16) / 2**32
        if n := int(rate) + (draw < rate - int(rate)):
            want[i] = n
    assert collections.Counter(r.doc_id for r in frames[4].collect()) == want
    assert mixing.MAX_RATE == 3

    import hashlib

    for r in frames[5].collect():
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(rows[4][r.doc_id].text.encode()).hexdigest()
    assert frames[5].count() == sum(want.values())


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and out.count() > 0


def test_near_duplicates_ships_no_sets_of_documents_half_alike(spark, monkeypatch):
    """Nine documents that share half their words pairwise are candidates, but only the copy with a word more is a link."""
    from netloom.llm import ngram_join

    held = {}

    def kept(df, name, store=ngram_join.stored):
        held[name] = store(df, name)
        return held[name]

    monkeypatch.setattr(ngram_join, "stored", kept)
    monkeypatch.setattr(ngram_join, "discard", lambda df: None)
    shared = " ".join(f"s{i}" for i in range(150))
    rows = [(i, shared + " " + " ".join(f"d{i}x{j}" for j in range(75))) for i in range(9)]
    rows.append((9, rows[0][1] + " more"))
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == list(range(9))
    assert held["join_sets"].count() == 2
