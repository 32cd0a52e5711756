"""Array helpers shared by the text operators.

Everything here works on one Arrow batch or one group inside a task. Words are maximal runs
of bytes other than 0x20 and 0x09-0x0D; in UTF-8 this equals the same rule on code points.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Prime of the window hashes, and two bases below it.
PRIME = (1 << 61) - 1
BASES = (0x1B873593CC9E2D51 % PRIME, 0x0A09E667F3BCC909 % PRIME)
_P, _61, _32, _29 = np.uint64(PRIME), np.uint64(61), np.uint64(32), np.uint64(29)
_LOW32, _LOW29 = np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
LANES = 8  # of eight bytes; longer words are hashed by xxh3


def byte_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every data[start:end]: eight bytes at a time, mixed after each eight."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    lanes = np.ndarray(len(padded) - 7, dtype=np.uint64, buffer=padded, strides=(1,))
    size = ends - starts
    h = mix64(size.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1))
    h = mix64(h ^ (lanes[starts] & _MASKS[np.minimum(size, 8)]))
    more = np.flatnonzero(size > 8)
    for at in range(8, 8 * LANES, 8):
        if not len(more):
            return h
        h[more] = mix64(h[more] ^ (lanes[starts[more] + at] & _MASKS[np.minimum(size[more] - at, 8)]))
        more = more[size[more] > at + 8]
    for k in more.tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return h


def _folded(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, c: int) -> np.ndarray:
    """a * c modulo PRIME, for values below it."""
    hi, lo = a >> _32, a & _LOW32
    c_hi, c_lo = np.uint64(c >> 32), np.uint64(c & 0xFFFFFFFF)
    mid, low = hi * c_lo + lo * c_hi, lo * c_lo
    return _folded(((hi * c_hi) << np.uint64(3)) + (mid >> _29) + ((mid & _LOW29) << _32) + (low & _P) + (low >> _61))


def rolling(values: np.ndarray, n: int, base: int = BASES[0]) -> np.ndarray:
    """Rabin-Karp hash, modulo PRIME, of every n consecutive values; hashes of 1, 2, 4, ... combine."""
    count = len(values) - n + 1
    if count < 1:
        return np.zeros(0, dtype=np.uint64)
    own, width, out, have = _folded(values), 1, None, 0
    while True:
        if n & width:
            out = own if out is None else _folded(_times(own[: len(own) - have], pow(base, have, PRIME)) + out[width:])
            have += width
        if 2 * width > n:
            return mix64(out[:count] + np.uint64(n * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        own = _folded(_times(own[:-width], pow(base, width, PRIME)) + own[width:])
        width *= 2


class Words:
    """The words of several texts: their hash, byte range and text number."""

    __slots__ = ("data", "doc", "ends", "first", "hash", "starts")

    def __init__(self, texts: list[bytes], lower: bool = False, separator: np.ndarray | None = None):
        space = SPACE if separator is None else separator
        self.data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        self.data = LOWER[self.data] if lower else self.data
        blank = np.empty(len(self.data) + 1, dtype=bool)
        blank[0] = True
        blank[1:] = space[self.data]
        self.starts = np.flatnonzero(blank[:-1] & ~blank[1:])
        self.ends = np.flatnonzero(~blank[:-1] & blank[1:])
        self.hash = byte_hash(self.data, self.starts, self.ends)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.starts, edges)  # of each text, and the end
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))


def slices(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text stands alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts as UTF-8; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


SMALL = 512  # bytes that stay as they are


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, byte planes apart."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.zeros((a.itemsize, 0), np.uint8)
        parts.append((a.dtype.str, len(a), planes.tobytes()))
    raw = pickle.dumps(parts, protocol=5)
    return b"\0" + raw if len(raw) < SMALL else b"\1" + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(blob[1:]) if blob[0] else blob[1:]):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, dtype=np.uint8).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n) if n else np.zeros(0, dtype=kind))
    return out


def pack_places(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, pos) sorted by doc as: differences of the distinct docs, rows of each, differences of pos."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ids = doc[new]
    return (
        np.diff(ids, prepend=np.int64(0)),
        np.diff(np.append(new, len(doc))).astype(np.int32),
        np.diff(pos.astype(np.int32), prepend=np.int32(0)),
    )


def unpack_places(ids: np.ndarray, counts: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.cumsum(ids), counts), np.cumsum(pos, dtype=np.int64)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text_col: str) -> int:
    return df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0


#: Bytes of text whose packed windows make a bucket, about; a bucket is one group of a task.
BUCKET_BYTES = 32 << 20


def buckets(spark: SparkSession, size: int) -> int:
    """A power of two for `size` bytes of text: the key space of packed rows.

    Buckets hold BUCKET_BYTES of text at most, and are four a shuffle partition at least.
    """
    least = max(4 * partitions(spark), -(-size // BUCKET_BYTES))
    return 1 << max(8, (least - 1).bit_length())


def spread(ids: np.ndarray, n: int) -> np.ndarray:
    """The group of an id among n; the same as spread_column()."""
    return np.mod(np.mod(ids, np.int64(1_000_003)) * np.int64(7_919) + np.mod(ids, np.int64(n)), np.int64(n))


def spread_column(id_col: str | Column, n: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.pmod(c, F.lit(1_000_003)) * F.lit(7_919) + F.pmod(c, F.lit(n)), F.lit(n)).cast("int")


def replaced(schema: T.StructType, new: list[T.StructField]) -> T.StructType:
    """schema with new fields behind; a field of the same name is replaced."""
    names = {f.name.lower() for f in new}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + new)


def squeezed(df: DataFrame, text_col: str) -> DataFrame:
    """The same rows with the text as zstd bytes, so that a shuffle of whole texts stays small."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == text_col else f.dataType) for f in df.schema])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            kind = pa.large_binary() if pa.types.is_large_string(b.column(at).type) else pa.binary()
            texts = b.column(at).cast(kind).to_pylist()
            small = pa.array([None if t is None else z.compress(t) for t in texts], pa.binary())
            yield b.set_column(at, pa.field(text_col, pa.binary()), small)

    return df.mapInArrow(run, schema)


def unsqueezed(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    z = zstandard.ZstdDecompressor()
    return [None if x is None else z.decompress(x) for x in column.to_pylist()]


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def is_long(df: DataFrame, id_col: str) -> DataFrame:
    return df.withColumn(id_col, F.col(id_col).cast("long"))
