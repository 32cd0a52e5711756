"""Language identification with error-correcting output codes.

Languages get codewords of bits. For every bit a binary n-gram classifier (log odds of hashed byte
n-grams, languages with the bit set against the others) gives a margin; decoding sums a weighted
loss of the margins against each codeword, takes the nearest and flags near ties.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.storage import stored
from flowlens.llm.textops import mix64, pack, replaced, unpack

BITS = 14
SIZE = 1 << BITS
ORDERS = (1, 2, 3, 4)
EVIDENCE = 48.0  # n-grams that count as independent, at most
WORDLY = re.compile(r"[^\W\d_]")
#: Bound of learning: labelled texts sampled a language, about.
SAMPLE = 3000
PIECE = 1 << 20
HELD = 64  # languages whose counts a task holds at once

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[48:58] = 48
_FOLD[[9, 10, 11, 12, 13]] = 32


@dataclass(frozen=True)
class Model:
    """languages[k] has codeword codes[k] of +1 and -1; weights: n-gram by bit; trust: of the bits."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray


def has_letter(text: str) -> bool:
    """Whether the text has a character of the Unicode categories L."""
    return any(m.group().isalpha() for m in WORDLY.finditer(text))  # \w has other numbers too


def counted(text: str, piece: int = PIECE) -> np.ndarray:
    """Counts of the hashed byte n-grams of the whole lower-cased text, `piece` bytes at a time."""
    v = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    total = np.zeros(SIZE, dtype=np.int64)
    for at in range(0, len(v), piece):
        own = _FOLD[v[at : at + piece + ORDERS[-1] - 1]] + np.uint32(1)  # n-grams that start in the piece
        h = np.zeros(len(own), dtype=np.uint32)
        for n in ORDERS:
            if len(own) < n:
                break
            h = h[: len(own) - n + 1] * np.uint32(0x01000193) + own[n - 1 :]
            got = ((h[:piece] ^ np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            total += np.bincount(got, minlength=SIZE)
    return total


def codewords(k: int) -> np.ndarray:
    """k distinct rows of +1 and -1: the exhaustive code up to 7 languages, else a random one.

    The random code starts with the binary digits of the row number, which keeps rows distinct.
    """
    if k < 2:
        return np.ones((k, 0), dtype=np.int8)
    if k <= 7:
        columns = np.arange(1, 1 << (k - 1))
        rows = [np.ones(len(columns), dtype=np.int8)]
        rows += [np.where(columns >> i & 1, -1, 1).astype(np.int8) for i in range(k - 1)]
        return np.stack(rows)
    row = np.arange(k, dtype=np.uint64)[:, None]
    digits = np.stack([(row[:, 0] >> np.uint64(b) & np.uint64(1)) for b in range((k - 1).bit_length())], axis=1)
    columns = np.arange(math.ceil(12 * math.log2(k)), dtype=np.uint64)[None, :]
    random = mix64(row * np.uint64(0x9E3779B97F4A7C15) + mix64(columns + np.uint64(1))) >> np.uint64(63)
    codes = np.where(np.concatenate([digits, random], axis=1) > 0, 1, -1).astype(np.int8)
    return codes[:, np.abs(codes.sum(axis=0)) < k]


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from labelled rows: all if few, else about `sample` texts a language, chosen by hash.

    Rows with a null text or language teach nothing; other columns are ignored; no row at all gives
    a model without languages. The driver holds the names of the languages and, for each bit of their
    codewords (which grow with the logarithm of their number), two vectors of SIZE.
    """
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    unit = 1 << 30
    sizes = rows.groupBy("lang").agg(F.least(F.lit(unit), F.ceil(unit * sample / F.count("*"))).alias("limit"))
    chosen = rows.join(stored(sizes, "lang-sizes"), "lang").where(F.pmod(F.xxhash64("text"), F.lit(unit)) < F.col("limit")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                had = total.setdefault(lang, np.zeros(SIZE, dtype=np.int64))
                had += counted(text)
            if len(total) > HELD:
                yield packed(total)
                total = {}
        if total:
            yield packed(total)

    def packed(total: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([pack(x) for x in total.values()], pa.binary())], names=["lang", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpack(x)[0] for x in table.column("counts").to_pylist())
        return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([pack(total)], pa.binary())})

    schema = "lang string, counts binary"
    learned = stored(chosen.mapInArrow(count, schema).groupBy("lang").applyInArrow(add, schema), "lang-counts")
    languages = sorted(r["lang"] for r in learned.select("lang").collect())
    codes = codewords(len(languages))
    row = df.sparkSession.sparkContext.broadcast({x: codes[k] for k, x in enumerate(languages)})

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each bit, sums of the n-gram shares of the languages on either side."""
        sums = np.zeros((2, codes.shape[1], SIZE))
        for b in batches:
            for lang, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = unpack(blob)[0]
                share = (got + 0.5) / (got.sum() + 0.5 * SIZE)
                up = row.value[lang] > 0
                sums[0, up] += share
                sums[1, ~up] += share
        yield pa.RecordBatch.from_arrays([pa.array(range(codes.shape[1]), pa.int32()), pa.array([pack(sums[0, k], sums[1, k]) for k in range(codes.shape[1])], pa.binary())], names=["bit", "sums"])

    def join(table: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in table.column("sums").to_pylist()]
        total = [pack(sum(p[0] for p in parts), sum(p[1] for p in parts))]
        return pa.table({"bit": table.column("bit").slice(0, 1), "sums": pa.array(total, pa.binary())})

    weights, trust = np.zeros((SIZE, codes.shape[1])), np.zeros(codes.shape[1])
    if codes.shape[1]:
        for r in learned.mapInArrow(halves, "bit int, sums binary").groupBy("bit").applyInArrow(join, "bit int, sums binary").collect():
            up, down = unpack(r["sums"])
            n = int((codes[:, r["bit"]] > 0).sum())
            p, q = up / n, down / (len(languages) - n)
            weights[:, r["bit"]] = np.log(p) - np.log(q)
            trust[r["bit"]] = ((p - q) * weights[:, r["bit"]]).sum()
    return Model(languages, codes, weights.astype(np.float32), trust / max(1e-12, trust.sum()) * max(1, len(trust)))


def decode(model: Model, text: str | None, margin: float = 0.5) -> tuple[str | None, float, bool]:
    """Language, score and whether another language is nearly as near."""
    if text is None or not has_letter(text):
        return "und", 0.0, False
    if not model.languages:
        return None, 0.0, True
    if len(model.languages) == 1:
        return model.languages[0], 1.0, False
    counts = counted(text)
    n = int(counts.sum())
    z = (counts.astype(np.float32) @ model.weights).astype(np.float64) / n * min(n, EVIDENCE)
    loss = (np.logaddexp(0.0, -model.codes * z) * model.trust).sum(axis=1)
    likely = np.exp(loss.min() - loss)
    likely /= likely.sum()
    best = int(np.argmax(likely))
    rest = np.delete(likely, best).max()
    return model.languages[best], float(min(1.0, likely[best])), bool(likely[best] - rest < margin)


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score (0 to 1) and ambiguous, from the whole texts alone.

    `und` with score 0 where the text is null or has no letter; null where no language was
    learned. Columns of df with these names are replaced. Ties go to the first language by name.
    """
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    schema = replaced(df.schema, new)
    kept = [df.columns.index(f.name) for f in schema.fields[: -len(new)]]
    text_at = df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # codewords, and SIZE weights a bit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [decode(shared.value, t.as_py()) for t in b.column(text_at)]
            new = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *new], names=schema.names)

    return df.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text is 0 modulo `folds`."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0
