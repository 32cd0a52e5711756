"""Expressions that give the same value in any engine and under any partitioning.

Sampling, splits and folds order rows by the MD5 of a seed and the row's key instead of a random
generator: the order does not depend on partitions, reruns agree, and plain SQL can repeat it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.sources.stage import stored


def key_hash(seed: str, key: Sequence[str]) -> Column:
    """MD5 (hex) of seed and key; key columns should be integers or strings."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in key)))


def hash_int(seed: str, key: Sequence[str]) -> Column:
    """The first 32 bits of key_hash() as a number."""
    return F.conv(F.substring(key_hash(seed, key), 1, 8), 16, 10).cast("long")


def hash01(seed: str, key: Sequence[str]) -> Column:
    """hash_int() as a fraction of 2**32."""
    return hash_int(seed, key) / F.lit(float(1 << 32))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with new columns computed once a row, however often they are read.

    Projections merge, and a hash read by several expressions would be computed in each; a generator
    of one row keeps them apart.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def apart(df: DataFrame) -> DataFrame:
    """df, its later steps compiled apart from those so far. Spark makes one method of a chain of projections, and
    the JVM only interprets methods of over 8,000 bytes. No partition is merged: there are never so many."""
    return df.coalesce(1 << 30)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rounded(c: Column, digits: int = 6) -> Column:
    """Half-even rounding that keeps the type double."""
    return F.bround(c.cast("double"), digits)


def hashed_rows(df: DataFrame, key: Sequence[str], seed: str) -> DataFrame:
    """df with _hash, and its first three hex digits as _digits."""
    return once(df, {"_hash": key_hash(seed, key)}).withColumn("_digits", F.substring("_hash", 1, 3))


def slice_counts(df: DataFrame, label: str, key: Sequence[str], seed: str) -> DataFrame:
    """(_class, _own, _n): rows of each class by the first three hex digits of their hash; stored, for
    it is small and both class sizes and places come from it."""
    counts = hashed_rows(df, key, seed).groupBy(F.col(label).alias("_class"), F.col("_digits").alias("_own")).agg(F.count("*").alias("_n"))
    return stored(counts, "class-slices")


def class_rank(df: DataFrame, label: str, key: Sequence[str], seed: str, name: str = "rank", counts: DataFrame | None = None) -> DataFrame:
    """df with each row's place (from 1) in its class by hash order; counts: slice_counts() of df, if known.

    A class may hold most rows, so no window spans one: rows are ranked within (class, first three
    hex digits), about 1/4096 of a class, and counts of the lower digits are added.
    """
    if counts is None:
        counts = slice_counts(df, label, key, seed)
    lower = Window.partitionBy("_class").orderBy("_own").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_class", "_own", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(label, "_digits").orderBy("_hash", *key)
    ranked = hashed_rows(df, key, seed).withColumn("_inside", F.row_number().over(inside))
    out = ranked.join(counts, ranked[label].eqNullSafe(counts["_class"]) & (ranked["_digits"] == counts["_own"]))
    return out.withColumn(name, F.col("_before") + F.col("_inside")).select(*df.columns, name)


def numbered(df: DataFrame, order: Sequence[str], name: str = "number", keep: Sequence[str] | None = None) -> DataFrame:
    """df with each row's number, from 0, in an order without ties: rows are cut into ranges and sorted,
    numbered inside them, and the sizes of earlier ranges added. One shuffle, stored; no task holds more
    than a range. keep: the columns wanted, by default all."""
    keep = df.columns if keep is None else list(keep)
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*keep, F.monotonically_increasing_id().alias("_id"))
    cut = stored(cut, "numbered").select(*keep, F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    upto = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = cut.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", (upto - F.col("_n")).alias("_before"))  # a row a partition
    return cut.join(F.broadcast(before), "_range").select(*keep, (F.col("_before") + F.col("_at")).alias(name))
