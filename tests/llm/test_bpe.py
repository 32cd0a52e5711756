"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlens.llm import queries
from flowlens.llm.bpe_codec import Codec, decode, encode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def spec():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def long_words(seed, n):
    r = random.Random(seed)
    kinds = ["ab", "aeiou", "etaoinshrdlu", "a", "th", "0123", "!.,", "a1.", "é漢字", "'stremvld", "</w>x", "AßΣİ 가̸́"]
    for _ in range(n):
        a = r.choice(kinds) + r.choice([*kinds, "", "", ""])
        w = "".join(r.choice(a) for _ in range(r.choice([1, 3, 20, 60, 300])))
        yield w[: len(w) // 2] + "<|endoftext|>" + w[len(w) // 2 :] if r.random() < 0.2 else w


@pytest.mark.parametrize("leaf", [1, 2, 5, 16])
def test_halves_join_exactly(spec, library, leaf):
    c = Codec(spec, leaf)
    for w in long_words(leaf, 400):
        assert sum((c.word(x) for x in w.split()), []) == library.encode(w, add_special_tokens=False).ids


def test_windows_grow_until_both_sides_agree(spec):
    """Mixed letters settle within some tokens of the join; a run of one letter may need all of it."""
    c, r = Codec(spec, 64), random.Random(9)
    sizes, part = [], c.part
    c.part = lambda s, final: sizes.append(len(s)) or part(s, final)
    for _ in range(300):
        w = "".join(r.choice("etaoinshrdlu") for _ in range(300))
        assert c.joined(part(w[:150], False), part(w[150:], True), True) == part(w, True)
    assert len(sizes) > 300 and max(sizes) < 150
    sizes.clear()
    assert c.joined(part("a" * 150, False), part("a" * 151, True), True) == part("a" * 301, True)
    assert len(sizes) > 1


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    huge = "".join(r.choice("etaoinshr") for _ in range(5_000))
    return {
        1: "Hello, world! It's 2024, isn't it?  <|endoftext|> A<|startoftext|>b <|ENDOFTEXT|>",
        2: None,
        3: "",
        4: " \n\t\x0b ",
        5: f"before {huge} after, {huge.upper()}! {huge[:3000]}12<|endoftext|>{huge[:2500]}",
        6: "x y z ́a \x1c\x1d éÉ H̱ ΑΣ ΟΔΟΣ. Ⅷ ½ a.b!?,c \x01 a\x01b",
        7: "Hello, world! It's 2024, isn't it?  <|endoftext|> A<|startoftext|>b <|ENDOFTEXT|>",
        8: "a" * 4_000,
        9: "word " * 50_000,
        None: "no id",
        -1: "漢字" * 3_000 + " '" + "!?" * 2_000,
    }


@pytest.mark.parametrize("split", [1 << 16, 2_000])
def test_texts_as_the_library_has_them(spark, spec, library, texts, split):
    rows = [(i, t, "mine") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    out = decode(encode(docs.withColumn("row", F.lit(7)), spec, leaf=100, split=split), spec)
    assert out.columns == ["doc_id", "text", "row", "ids", "decoded"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["text"] == t and got[i]["row"] == 7
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_repeated_rows_and_an_empty_table(spark, spec):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (1, "z" * 3_000), (1, "z" * 3_000)], "doc_id long, text string")
    got = [r["ids"] for r in encode(docs, spec, leaf=50, split=1_000).collect()]
    assert len(got) == 4 and len({tuple(x) for x in got}) == 2
    assert encode(docs.limit(0), spec).count() == 0


def test_ids_that_do_not_exist(spark, spec, library):
    df = spark.createDataFrame([(1, [320, -1, 60_000, 49407]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r for r in decode(df, spec, digest="ids_sha256").collect()}
    assert got[1]["decoded"] == library.decode([320, 49407], skip_special_tokens=False)
    assert got[2]["decoded"] is None and got[2]["ids_sha256"] is None
    assert got[3]["decoded"] == "" and got[3]["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_other_kinds_of_vocabulary_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        Codec(f.read())


def test_query_over_all_documents(spark, small, library):
    got = {r["doc_id"]: r for r in queries.op13_bpe(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
