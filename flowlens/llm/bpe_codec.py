"""Byte-pair encoding and decoding of whole texts, long unsplit text by tree concatenation.

The vocabulary is a file of the tokenizers library whose pre-tokenizer drops white space, so a text
may be cut at ASCII blanks: no special token, normalisation or piece reaches over one. A word's ids
depend on the word alone and are encoded once a worker. A word without a blank that is longer than
`leaf` is normalised and split into pieces; the halves of a long piece are encoded apart, and around
their join a window of tokens is encoded again, doubled until its first and its last token are those
that the halves have there. Two neighbouring tokens of a right encoding always encode to themselves,
and a sequence in which all neighbours do is the right encoding, so the result is exact. Words over
`split` bytes have their pieces cut into leaves that Spark deals over the cluster and joins pairwise,
level by level; a shorter word is joined within its task.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from flowlens.llm.storage import stored
from flowlens.llm.textops import fresh, replaced, slices, utf8

LEAF = 1024  # symbols of a piece that is encoded at once
SPLIT = 1 << 16  # bytes of a word whose leaves are dealt over the cluster
CACHED = 1 << 17  # words a worker remembers, and as many that it used before those,
CACHED_BYTES = 64  # each of so many bytes at most
IDS = T.ArrayType(T.IntegerType())
#: With this pattern of pieces (a fixed value) a match that begins with a letter or digit ends before a stop.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STOPS = re.compile(rb"(?<=[A-Za-z0-9])(?=[.,;:!?])")


class Codec:
    """The encoders of one vocabulary file."""

    def __init__(self, spec: str, leaf: int = LEAF):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        self.leaf = leaf
        self.whole = Tokenizer.from_str(spec)
        self.whole.no_truncation()
        self.whole.no_padding()
        file = json.loads(spec)
        for t in file["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or not t["content"]:
                raise ValueError(f"special tokens with options are not supported: {t['content']!r}")
        if file["model"]["type"] != "BPE" or file["model"].get("dropout") or file["model"].get("ignore_merges") or file["decoder"]:
            raise ValueError("not a plain BPE vocabulary without a decoder")
        if self.ids("a b") != self.ids("a") + self.ids("b") or self.ids(" \n"):
            raise ValueError("the pre-tokenizer must drop white space")
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        splits = (file["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.stops = splits.get("pattern") == {"Regex": LETTERS_APART} and not any(re.search("[.,;:!?]", t) for t in self.special)
        self.suffix = file["model"].get("end_of_word_suffix") or ""
        file |= {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
        self.bare = file
        self.tokens = [self.whole.id_to_token(i) or "" for i in range(self.whole.get_vocab_size())]
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @functools.cached_property
    def last(self) -> Tokenizer:
        """Of whole pieces and their ends."""
        return Tokenizer.from_str(json.dumps(self.bare))

    @functools.cached_property
    def inner(self) -> Tokenizer:
        """Of parts of a piece before its end."""
        return Tokenizer.from_str(json.dumps(self.bare | {"model": self.bare["model"] | {"end_of_word_suffix": None}}))

    def ids(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def part(self, symbols: str, final: bool) -> list[int]:
        return (self.last if final else self.inner).encode(symbols, add_special_tokens=False).ids

    def joined(self, left: list[int], right: list[int], final: bool) -> list[int]:
        """The encoding of two neighbouring parts of a piece, from theirs; final: right ends the piece."""
        k = 2
        while True:
            a, b = left[-k:], right[:k]
            end = k >= len(right)
            text = "".join(self.tokens[i] for i in a + b)
            if end and final and self.suffix:
                text = text[: -len(self.suffix)]
            window = self.part(text, end and final)
            if (k >= len(left) or window[0] == a[0]) and (end or window[-1] == b[-1]):
                return left[:-k] + window + right[k:]
            k *= 2

    def tree(self, symbols: str, final: bool = True) -> list[int]:
        """The ids of a part of a piece, by halves."""
        if len(symbols) <= self.leaf:
            return self.part(symbols, final)
        half = len(symbols) // 2
        return self.joined(self.tree(symbols[:half], False), self.tree(symbols[half:], final), final)

    def pieces(self, word: str) -> Iterator[int | str]:
        """A long word as ids of special tokens and pieces of symbols."""
        for text in self.marks.split(word) if self.marks else [word]:
            if text in self.special:
                yield self.special[text]
            elif text:
                yield from (p for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(text)))

    def word(self, word: str) -> list[int]:
        out: list[int] = []
        for p in self.pieces(word):
            out += [p] if isinstance(p, int) else self.tree(p)
        return out

    def learn(self, words: list[bytes]) -> None:
        """Puts the ids of new words into the cache."""
        short = [w for w in words if len(w) <= self.leaf]
        for w, e in zip(short, self.whole.encode_batch([w.decode("utf-8", "replace") for w in short], add_special_tokens=False), strict=True):
            self.cache[w] = np.array(e.ids, dtype="<u4").tobytes()
        for w in words if len(short) < len(words) else ():
            if len(w) > self.leaf:
                self.cache[w] = np.array(self.word(w.decode("utf-8", "replace")), dtype="<u4").tobytes()

    def encoded(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for lo, hi in slices(texts):
            split = [(STOPS.sub(b" ", t) if self.stops else t).split() for t in texts[lo:hi]]
            if len(self.cache) > CACHED:
                self.cache, self.older = {}, self.cache
            new = list(set().union(*split).difference(self.cache))
            self.cache.update((w, self.older[w]) for w in new if w in self.older)
            self.learn([w for w in new if w not in self.cache])
            yield from (b"".join(map(self.cache.__getitem__, words)) for words in split)
            for w in new:
                if len(w) > CACHED_BYTES:
                    del self.cache[w]


@functools.lru_cache(maxsize=2)
def codec(spec: str, leaf: int) -> Codec:
    return Codec(spec, leaf)


def lists(blobs: list[bytes]) -> pa.ListArray:
    edges = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(edges, pa.array(np.frombuffer(b"".join(blobs), dtype="<i4")))


def _encoded(docs: DataFrame, spec: str, text_col: str, out: str, leaf: int) -> DataFrame:
    schema = replaced(docs.schema, [T.StructField(out, IDS)])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec, leaf)
        for b in batches:
            texts = utf8(b.column(text_col))
            for lo, hi in slices(texts, 4 << 20):
                ids = lists(list(c.encoded(texts[lo:hi])))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, hi - lo) for k in keep), ids], names=[*keep, out])

    return docs.mapInArrow(run, schema)


def _spread(docs: DataFrame, spec: str, text_col: str, out: str, leaf: int, split: int) -> DataFrame:
    """_encoded() for texts with very long words: their leaves are encoded in tasks of their own.

    Returns docs (with a stored row number) and the ids, put together again row by row.
    """
    row = fresh(docs, "_row")
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "bpe-long")  # written, so the numbers stay

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of each text in order: finished ids (leaves = 0) or a leaf of a long piece."""
        c = codec(spec, leaf)
        names = ["row", "seq", "leaf", "leaves", "ids", "symbols"]
        for b in batches:
            for number, text in zip(b.column(row).to_pylist(), utf8(b.column(text_col)), strict=True):
                seq, done, parts, group = 0, [], [], []
                for w in [*text.split(), None]:
                    if w is not None and len(w) <= split:
                        group.append(w)
                        continue
                    done += c.encoded([b" ".join(group)])
                    group = []
                    for p in c.pieces(w.decode("utf-8", "replace")) if w else ():
                        if isinstance(p, int):
                            done.append(np.array([p], dtype="<u4").tobytes())
                        elif len(p) <= leaf:
                            done.append(np.array(c.part(p, True), dtype="<u4").tobytes())
                        else:
                            parts.append((number, seq, 0, 0, np.frombuffer(b"".join(done), dtype="<i4"), None))
                            done, n = [], -(-len(p) // leaf)
                            parts += [(number, seq + 1, k, n, None, p[k * leaf : (k + 1) * leaf]) for k in range(n)]
                            seq += 2
                parts.append((number, seq, 0, 0, np.frombuffer(b"".join(done), dtype="<i4"), None))
                for at in range(0, len(parts), 1024):
                    columns = zip(*parts[at : at + 1024], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32()), pa.string()]
    parts = stored(docs.select(row, text_col).mapInArrow(cut, "row long, seq long, leaf long, leaves long, ids array<int>, symbols string"), "bpe-parts")

    def encode_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(spec, leaf)
        for b in batches:
            b["ids"] = [c.part(s, k + 1 == n) for s, k, n in zip(b["symbols"], b["leaf"], b["leaves"], strict=True)]
            yield b[["row", "seq", "leaf", "leaves", "ids"]]

    def join_two(group: pd.DataFrame) -> pd.DataFrame:
        c = codec(spec, leaf)
        group = group.sort_values("leaf")
        first, n = group.iloc[0], int(group["leaves"].iloc[0])
        ids = [int(i) for i in first["ids"]]
        if len(group) == 2:
            ids = c.joined(ids, [int(i) for i in group["ids"].iloc[1]], int(first["leaf"]) + 2 == n)
        return pd.DataFrame([(first["row"], first["seq"], first["leaf"] // 2, -(-n // 2), ids)], columns=["row", "seq", "leaf", "leaves", "ids"])

    shape = "row long, seq long, leaf long, leaves long, ids array<int>"
    level = parts.where("leaves > 0").drop("ids").repartition("row", "seq", "leaf").mapInPandas(encode_leaves, shape)
    n = parts.agg(F.max("leaves")).first()[0] or 0
    while n > 1:
        level = level.groupBy("row", "seq", F.floor(F.col("leaf") / 2).alias("node")).applyInPandas(join_two, shape)
        n = -(-n // 2)
    whole = parts.where("leaves = 0").select("row", "seq", "ids").unionByName(level.select("row", "seq", "ids"))
    whole = whole.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("all"))
    whole = whole.select("row", F.flatten(F.transform("all", lambda x: x["ids"])).alias("_ids"))
    names = [f.name for f in replaced(docs.schema, [T.StructField(out, IDS)]).fields[:-1] if f.name != row]
    joined = docs.join(whole, docs[row] == whole["row"], "left")
    return joined.select(*(docs[f"`{c}`"] for c in names), F.coalesce("_ids", F.array().cast(IDS)).alias(out))


def encode(docs: DataFrame, spec: str, text_col: str = "text", out: str = "ids", leaf: int = LEAF, split: int = SPLIT) -> DataFrame:
    """docs with the token ids of every whole text; spec: the JSON of the vocabulary file.

    Null and empty texts get no ids. Every row is encoded for itself, so repeated rows, null or equal
    ids and other columns are as they were; a column named as `out` is replaced. A text is cut within
    one task, which needs some 30 times its size in memory, 100 times a word over `split` bytes.
    """
    codec(spec, leaf)  # unsupported files fail here
    blank = r"(?<!\S)\S{%d}" % (split // 4)  # characters have four bytes at most
    long = F.coalesce((F.octet_length(text_col) > split) & F.col(text_col).rlike(blank), F.lit(False))
    spread = docs.where(long)
    short = _encoded(docs.where(~long), spec, text_col, out, leaf)
    return short if spread.isEmpty() else short.unionByName(_spread(spread, spec, text_col, out, leaf, split))


def decode(df: DataFrame, spec: str, ids_col: str = "ids", out: str = "decoded", digest: str | None = None) -> DataFrame:
    """df with the text of the ids: tokens with a blank between, as a vocabulary without a decoder has it.

    digest: a column for the hex SHA-256 of the ids as little-endian unsigned 32-bit integers, too.
    Special tokens stay. Null ids give null, an id outside the vocabulary nothing; columns named as the
    new ones are replaced. The tokens are a literal of the plan; no Python runs.
    """
    tokens = codec(spec, LEAF).tokens
    if any(" " in t for t in tokens):
        raise ValueError("tokens with blanks are not supported")
    # A split of a constant is folded to an array once; the list is as long as the vocabulary.
    words = F.split(F.lit(" ".join(tokens)), " ")
    known = F.filter(ids_col, lambda i: (i >= 0) & (i < len(tokens)))
    columns = {out: F.array_join(F.transform(known, lambda i: F.element_at(words, i + 1)), " ")}
    if digest:
        hexes = F.split(F.lit(" ".join(i.to_bytes(4, "little").hex() for i in range(len(tokens)))), " ")
        columns[digest] = F.sha2(F.unhex(F.array_join(F.transform(known, lambda i: F.element_at(hexes, i + 1)), "")), 256)
    new = {c.lower() for c in columns}
    return df.select(*(df[f"`{c}`"] for c in df.columns if c.lower() not in new), *(c.alias(name) for name, c in columns.items()))
