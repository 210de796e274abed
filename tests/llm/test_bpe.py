import hashlib
import json
import random

import pytest

from netloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

PARTS = ["a", "b", "'s", "'re", "'", "t", "ll", " ", "  ", "\n", "\t", "é", "ß", "中", "١", "²", "!", "?!", "123", "😀", "é", "<|endoftext|>", "<|endof", "\x00", "\x1c", "\x85", "the", " don't", "'S", "aaa", "aaaa", "\r\n", "ſ", " "]


def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 40))) for _ in range(1500)]
    return ["", "<|endoftext|>", "x 's", "'s's", "''s", "\n's", "we'll've", "a" * 5000, *made]


def test_ids_and_round_trip_match_the_library(spark):
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in bpe.encoded(df, bpe.default_path(), {"n": "n_tokens", "ids": "ids", "d": "decoded"}).collect()}
    for i, x in rows:
        want = t.encode(x, add_special_tokens=False).ids
        assert out[i].ids == want and out[i].n == len(want), repr(x)
        assert out[i].d == t.decode(want, skip_special_tokens=False)


def test_report_and_decode(spark):
    df = spark.createDataFrame([(1, "hello world"), (1, "hello world"), (2, None), (None, "")], "doc_id long, text string")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    import numpy as np

    want = hashlib.sha256(np.array(t.encode("hello world").ids, "<u4").tobytes()).hexdigest()
    rows = bpe.report(df).collect()
    assert [r.ids_sha256 for r in rows if r.doc_id == 1] == [want, want]
    assert {r.n_tokens for r in rows if r.doc_id != 1} == {0}
    back = bpe.decoded(bpe.encoded(df, bpe.default_path(), {"ids": "ids"}), bpe.default_path()).collect()
    assert [r.decoded for r in back] == [r.text or "" for r in back]


def test_small_groups_share_what_is_known(spark, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP_BYTES", 64)
    monkeypatch.setattr(bpe, "KEPT_TOKENS", 5)
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    import pyarrow as pa

    from netloom.llm import textops

    monkeypatch.setattr(textops, "CHUNK_BYTES", 32)
    enc = bpe.Encoder(bpe.Codec.load(bpe.default_path()))
    some = texts()[:200]
    got = [list(x) for g in bpe.groups(pa.array(some)) for x in enc.encode(g)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in some]


@pytest.mark.parametrize("path", [("model", "ignore_merges"), ("pre_tokenizer", "use_regex"), ("normalizer",), ("added_tokens", 0, "lstrip")])
def test_settings_that_are_not_followed_raise(tmp_path, path):
    with open(bpe.default_path(), encoding="utf-8") as f:
        d = json.load(f)
    at = d
    for x in path[:-1]:
        at = at[x]
    at[path[-1]] = {"type": "NFC"} if path[-1] == "normalizer" else not at[path[-1]]
    (tmp_path / "t.json").write_text(json.dumps(d), "utf-8")
    with pytest.raises(ValueError, match=path[-1]):
        bpe.Codec.load(str(tmp_path / "t.json"))


def test_columns_of_the_outputs_names_give_way(spark):
    df = spark.createDataFrame([("x", "hello", [1])], "N_tokens string, text string, ids array<int>")
    out = bpe.encoded(df, bpe.default_path(), {"n_tokens": "n_tokens", "ids": "ids"})
    assert out.columns == ["text", "n_tokens", "ids"] and out.first().n_tokens == len(out.first().ids)
    assert bpe.decoded(out, bpe.default_path(), name="text").first().text == "hello"


def test_empty_table(spark):
    assert bpe.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
