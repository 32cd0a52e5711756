"""Exact order statistics of many columns at once, without a sort and without holding distinct values."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.local import local_table

WIDTHS = (13, 13, 13, 13, 12)  # bits of a value that each scan settles
MOST = 512  # ranks searched at once: 34 MB of counts a task
_TOP = np.uint64(1 << 63)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; -0.0 as 0.0."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def from_bits(key: int) -> float:
    bits = key & ~(1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


def order_statistics(df: DataFrame, ranks: Mapping[str, Sequence[int]]) -> dict[tuple[str, int], float]:
    """(column, rank) -> the value of that rank, from 0, among the column's values without nulls.

    Columns are doubles without NaN; ranks lie below the number of values. A value's bits are settled
    from the top in five scans for each MOST ranks, whatever the data: each counts, among the values that share the bits
    found so far, those of each next digit. A task holds a count a digit (8,192) for each wanted prefix;
    the driver gets a row for each wanted rank.
    """
    wants = [(c, int(r)) for c, rs in ranks.items() for r in sorted(set(rs))]
    if len(wants) > MOST and len({c for c, _ in wants}) > 1:
        names = list(ranks)
        halves = (names[: len(names) // 2], names[len(names) // 2 :])
        return {k: v for half in halves for k, v in order_statistics(df, {c: ranks[c] for c in half}).items()}
    left, prefix = {w: w[1] for w in wants}, dict.fromkeys(wants, 0)
    columns, shift = [c for c in ranks if ranks[c]], 64
    for width in WIDTHS if wants else ():
        shift -= width
        groups = sorted({(w[0], prefix[w]) for w in wants})
        by = {c: [(g, p) for g, (own, p) in enumerate(groups) if own == c] for c in columns}

        def count(batches: Iterator[pa.RecordBatch], width=width, shift=shift, by=by, n=len(groups)) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n, 1 << width), dtype=np.int64)
            for b in batches:
                for c, own in by.items():
                    column = b.column(columns.index(c))
                    key = ordered_bits(column.drop_null().to_numpy(zero_copy_only=False))
                    digit = ((key >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
                    above = key >> np.uint64(shift + width) if shift + width < 64 else np.zeros(len(key), np.uint64)
                    for g, p in own:
                        total[g] += np.bincount(digit[above == np.uint64(p)], minlength=1 << width)
            g, d = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(d), pa.array(total[g, d])], names=["g", "d", "n"])

        digits = df.select(*(F.col(f"`{c}`").cast("double") for c in columns)).mapInArrow(count, "g long, d long, n long").groupBy("g", "d").agg(F.sum("n").alias("n"))
        upto = digits.withColumn("upto", F.sum("n").over(Window.partitionBy("g").orderBy("d")))  # 8,192 rows a group at most
        number = {g: i for i, g in enumerate(groups)}
        asked = local_table(df.sparkSession, [(i, number[w[0], prefix[w]], left[w]) for i, w in enumerate(wants)], "w long, g long, r long")
        got = upto.join(F.broadcast(asked), "g").where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("n")))  # a row a rank
        found = got.select("w", "d", (F.col("upto") - F.col("n")).alias("before")).collect()
        if len(found) < len(wants):
            raise ValueError("a rank is not below the number of values")
        for w, d, before in found:
            left[wants[w]] -= before
            prefix[wants[w]] = prefix[wants[w]] << width | d
    return {w: from_bits(prefix[w]) for w in wants}


def places(n: int, q: float) -> tuple[int, int, float]:
    """The ranks on both sides of quantile q of n values, and its position between."""
    at = q * (n - 1)
    low = int(np.floor(at))
    return low, int(np.ceil(at)), at - low


def between(low: float, high: float, share: float) -> float:
    return low if low == high or share == 0 else (1 - share) * low + share * high


def quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], counts: Mapping[str, int] | None = None) -> dict[tuple[str, float], float | None]:
    """(column, q) -> the interpolated quantile, null of no values; counts: values of each column, if known."""
    if counts is None:
        counts = df.agg(*(F.count(f"`{c}`").alias(c) for c in wanted)).first().asDict()
    ends = {(c, q): places(counts[c], q) for c, qs in wanted.items() for q in qs if counts[c]}
    got = order_statistics(df, {c: [r for q in qs if counts[c] for r in ends[c, q][:2]] for c, qs in wanted.items()})
    return {(c, q): between(got[c, ends[c, q][0]], got[c, ends[c, q][1]], ends[c, q][2]) if counts[c] else None for c, qs in wanted.items() for q in qs}
