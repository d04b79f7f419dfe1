"""Ids equal those of the public libraries, and decode to the text."""

import base64
from pathlib import Path

import pytest
import tiktoken
from pyspark.sql import functions as F

from strandline.llm import encoding as E
from strandline.llm.mixing import mix, rates, shares

TEXTS = [
    None, "", " ", "\n\n  x", "Hello world's <|endoftext|> it'll", "naïve Ünïcödé — “quotes” 東京 🙂🙂", "a" * 700, "=" * 900, "ab" * 600, "x y z\t\t\r\n", "1234567890 12,345.67", "Привет, мир! Это тест.",
    "the " * 3000, " \x1c\x85 end", "don't DON'T 'sx", "Hello world's <|endoftext|> it'll",
]


@pytest.fixture(scope="module")
def tok():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(E.TOKENIZERS, "byte_bpe_50k.tiktoken").read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids(spark, tok):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")  # a clashing name
    got = {r.doc_id: r.ids for r in E.encode(df, "doc_id", "text").collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == (tok.encode_ordinary(t) if t else []), repr(t)[:60]
        assert tok.decode(got[i]) == (t or "")
    assert E.encode(df.limit(0), "doc_id", "text").count() == 0


def test_decode(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in E.decode(E.encode(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [15496, 999_999]), (4, [128])], "k int, ids array<long>")
    assert {r.k: r.text for r in E.decode(odd, "k", "ids").collect()} == {1: None, 2: "", 3: "Hello\ufffd", 4: E.load_vocabulary().pieces[128].decode("utf-8", "replace")}
    assert E.decode(odd.limit(0), "k", "ids").count() == 0


def test_a_vocabulary_of_ranks_alone(tok):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(E.TOKENIZERS, "byte_bpe_multi_50k.tiktoken").read_bytes().splitlines())}
    other = tiktoken.Encoding("multi", pat_str=E.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e = E.Encoder(E.load_vocabulary("byte_bpe_multi_50k"))
    assert e.encode(TEXTS).to_pylist() == [other.encode_ordinary(t) if t else [] for t in TEXTS]


def test_very_long_words(tok):
    """One word of 300,000 letters, and many of just under the bound: neither time nor memory runs away."""
    e = E.Encoder(E.load_vocabulary())
    texts = ["".join(chr(97 + (i * i) % 23 % 26) for i in range(300_000)), "é" * 100_000, " ".join("".join(chr(97 + (i * k) % 26) for i in range(250)) for k in range(300))]
    assert e.encode(texts).to_pylist() == [tok.encode_ordinary(t) for t in texts]


def test_words_are_forgotten_in_bounds(tok, monkeypatch):
    monkeypatch.setattr(E, "WORDS", 5)
    e = E.Encoder(E.load_vocabulary())
    for k in range(4):
        t = [f"word{k}x{i} and more" for i in range(10)]
        assert e.encode(t).to_pylist() == [tok.encode_ordinary(x) for x in t]
    assert len(e.known) <= 60


def test_mix(spark):
    docs = [(i, s, n, "x") for s, k, n in (("big", 400, 50), ("small", 20, 30), ("rest", 10, 5)) for i in range(k)]
    df = spark.createDataFrame(docs, "id long, source string, size long, copy string")
    t = spark.createDataFrame([(" Big", 0.5, 2), ("SMALL", 0.4, 4), ("none", 0.1, 3), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    r = rates(df, t)
    m = mix(df, r)
    got = {x.source: x for x in shares(m, r).collect()}
    assert set(got) == {"big", "small", "none"} and got["none"].copies == 0
    assert got["small"].copies == 80 and got["small"].most_repeats == 4  # the scarcest source, used in full
    assert abs(got["big"].actual_share / got["small"].actual_share - 0.5 / 0.4) < 0.5
    assert m.groupBy("id", "source").count().where("count > 4").count() == 0
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, mix(df.repartition(7), r).collect()))
    assert shares(mix(df.limit(0), rates(df.limit(0), t)), rates(df.limit(0), t)).agg(F.sum("copies")).first()[0] == 0
