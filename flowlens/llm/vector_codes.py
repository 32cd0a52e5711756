"""Vector code compression: codebooks of vector parts, learned exactly with distances to fixed pivots.

Each vector is cut into parts of whole numbers and each part position has a codebook. Distances from
every part to a few fixed pivots are computed once and stored beside the part. In a round only the
distances from pivots to entries are new: |d(part, pivot) - d(entry, pivot)| bounds the distance of
part and entry from below, so entries are tried in order of their bound and left out once the bound
passes the best exact distance. What is decided is decided by exact integers; the bounds are lowered
by more than the error of their floats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.storage import stored
from flowlens.llm.textops import fresh

SCALE = 4096
PIVOTS = 4
#: Larger components could pass 64 bits in a squared distance.
MOST = 1 << 27
SLACK = 1e-6  # of the sum of two distances; they are kept as 32-bit floats, of error 6e-8


@dataclass
class Compressed:
    """codes: the rows with code and error; books: (parts, entries, width) integers; work: by round,
    exact distances evaluated and those that all pairs of part and entry would take."""

    codes: DataFrame
    books: np.ndarray
    work: list[tuple[int, int]]

    def books_sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("...i,...i->...", d, d)


def pivots_of(entries: np.ndarray, n: int) -> np.ndarray:
    """n entries far from each other: each is that of the largest sum of distances to those before."""
    chosen, far = [0], np.zeros(len(entries))
    while len(chosen) < min(n, len(entries)):
        far = far + np.sqrt(squared(entries, entries[chosen[-1]]).astype(float))
        far[chosen] = -1.0
        chosen.append(int(far.argmax()))
    return entries[chosen]


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each part (ties: the lower index), its squared distance, and how many
    exact distances that took. to_pivots: distances of the parts to the pivots."""
    between = np.sqrt(squared(entries[:, None, :], pivots[None, :, :]).astype(float))
    bound = np.zeros((len(x), len(entries)))
    for p in range(len(pivots)):
        a, b = to_pivots[:, p, None], between[None, :, p]
        np.maximum(bound, np.abs(a - b) - SLACK * (a + b), out=bound)
    bound *= bound
    order = np.argsort(bound, axis=1, kind="stable")
    index = order[:, 0].copy()
    best = squared(x, entries[index])
    live, tried = np.arange(len(x)), len(x)
    for k in range(1, len(entries)):
        entry = order[live, k]
        near = bound[live, entry] <= best[live]
        live, entry = live[near], entry[near]
        if not len(live):
            break
        tried += len(live)
        d = squared(x[live], entries[entry])
        better = (d < best[live]) | ((d == best[live]) & (entry < index[live]))
        best[live[better]], index[live[better]] = d[better], entry[better]
    return index, best, tried


def whole_parts(df: DataFrame, vec_col: str) -> tuple[DataFrame, str]:
    """Rows whose vector holds finite numbers alone, with floor(SCALE * x) in place of the vector."""
    name = fresh(df, "_parts")
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = df.where(F.coalesce(fine & (F.size(v) > 0), F.lit(False)))
    return kept.withColumn(name, F.transform(v, lambda x: F.floor(x * F.lit(float(SCALE))).cast("long"))).drop(vec_col), name


def matrix(column: pa.ChunkedArray | pa.Array, parts: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), parts, -1)


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, pivots: int = PIVOTS) -> Compressed:
    """The code of every vector: the entry of each part, two hex digits each, and the summed error.

    Rows whose vector is null, empty or holds a null, NaN or infinite component are dropped, and so are
    vectors of another length than that of the smallest id. That length must be a multiple of `parts`
    and components below 2^27 / 4096 in size, else it is an error. Each codebook starts with the parts
    of the vectors of the smallest ids (null ids last; equal ids in order of their components); fewer
    rows than entries give smaller codebooks, none gives no row. Repeated rows count as often as they
    stand. Other columns stay, the vector goes; columns named code or error are replaced. The driver
    holds the codebooks and their sums, some kilobytes whatever the input.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry has two hex digits")
    df = df.drop("code", "error")
    kept, whole = whole_parts(df, vec_col)
    first = [r[0] for r in kept.orderBy(F.col(id_col).asc_nulls_last(), whole).select(whole).limit(entries).collect()]
    if first:
        first = [r for r in first if len(r) == len(first[0])]
        size = len(first[0])
        if size % parts:
            raise ValueError(f"{size} components can't be cut into {parts} equal parts")
        same = kept.where(F.size(whole) == size)
        if len(first) < entries:  # the others were of another length
            first = [r[0] for r in same.orderBy(F.col(id_col).asc_nulls_last(), whole).select(whole).limit(entries).collect()]
        kept = same
    else:
        first, size = [[0] * parts], parts
    books = np.array(first, dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    fixed = np.stack([pivots_of(b, pivots) for b in books])
    names = [c for c in kept.columns if c != whole]
    away = fresh(kept, "_pivots")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts, and once for all their distances to the pivots."""
        for b in batches:
            x = matrix(b.column(whole), parts)
            if x.size and (x.max() >= MOST or x.min() <= -MOST):
                raise ValueError(f"components of {MOST / SCALE:.0f} and more can't be compressed")
            d = np.sqrt(squared(x[:, :, None, :], fixed[None]).astype(float)).astype(np.float32)
            lists = [pa.ListArray.from_arrays(np.arange(0, a.size + 1, a[0].size, dtype=np.int32), pa.array(a.reshape(-1))) if len(a) else pa.array([], pa.list_(pa.from_numpy_dtype(a.dtype))) for a in (x.astype(np.int32), d)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *lists], names=[*names, whole, away])

    schema = T.StructType([f for f in kept.schema.fields if f.name != whole] + [T.StructField(whole, T.ArrayType(T.IntegerType())), T.StructField(away, T.ArrayType(T.FloatType()))])
    measured = stored(kept.mapInArrow(measure, schema), "vector-parts")

    def assigned(b: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
        x, d = matrix(b.column(whole), parts).astype(np.int64), matrix(b.column(away), parts)
        for j in range(parts):
            yield j, x[:, j], *nearest(x[:, j], d[:, j].astype(float), books[j], fixed[j])

    def sums(books: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of one task: the sum of the parts of each entry and their number; evaluations at place -1."""
            total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            work = np.zeros(2, np.int64)
            for b in batches:
                for j, x, index, _, tried in assigned(b, books):
                    count[j] += np.bincount(index, minlength=books.shape[1])
                    for k in range(books.shape[2]):  # sums of a batch are exact as floats, being below 2^53
                        total[j, :, k] += np.bincount(index, weights=x[:, k], minlength=books.shape[1]).astype(np.int64)
                    work += (tried, len(x) * books.shape[1])
            j, e, k = np.nonzero(np.broadcast_to(count[:, :, None] > 0, total.shape))
            columns = [np.append(j, -1), np.append(e, 0), np.append(k, 0), np.append(total[j, e, k], work[0]), np.append(count[j, e], work[1])]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["part", "entry", "place", "total", "n"])

        return run

    work = []
    for _ in range(rounds):
        rows = measured.select(whole, away).mapInArrow(sums(books), "part long, entry long, place long, total long, n long")
        books = books.copy()
        for r in rows.groupBy("part", "entry", "place").agg(F.sum("total"), F.sum("n")).collect():  # parts x entries x width numbers
            if r[0] < 0:
                work.append((r[3], r[4]))
            else:
                books[r[0], r[1], r[2]] = r[3] // r[4]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, error = np.zeros((b.num_rows, parts), np.uint8), np.zeros(b.num_rows, np.int64)
            for j, _, index, best, _ in assigned(b, books):
                codes[:, j] = index
                error += best
            own = [pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *own], names=[*names, "code", "error"])

    out = T.StructType([measured.schema[c] for c in names] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return Compressed(measured.mapInArrow(code, out), books, work)


def with_label_error(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """codes with label_error: the error summed over the rows of an equal label, nulls together.

    Errors are summed before the shuffle, and each label has one row in the join, which Spark splits
    where a label is hot. A column named label_error is replaced.
    """
    codes = stored(codes.drop("label_error"), "vector-codes")
    own, total = fresh(codes, "_label"), fresh(codes, "_total")
    by = stored(codes.groupBy(F.col(label_col).alias(own)).agg(F.sum("error").alias(total)), "vector-labels")
    return codes.join(by, codes[label_col].eqNullSafe(by[own]), "left").withColumnRenamed(total, "label_error").drop(own)
