"""Cleaning: missing values, duplicates and what they were."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """c, null where it is NaN or infinite."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(INF)), F.lit(None)).otherwise(c)


def nulls_for_nonfinite(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in features})


def drop_empty(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df without rows whose features are all null."""
    return df.na.drop(how="all", subset=list(features))


def drop_duplicates(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str]) -> DataFrame:
    """One row, that of the smallest key, of rows equal in all features and label."""
    rest = [c for c in df.columns if c not in {*features, label, *key}]
    best = F.min(F.struct(*key, *rest)).alias("_kept")
    out = df.groupBy(*features, label).agg(best)
    return out.select(*(F.col(f"_kept.{c}").alias(c) if c in {*key, *rest} else F.col(c) for c in df.columns))


def contradictions(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Feature vectors that carry more than one label, with the number of labels and rows."""
    out = df.groupBy(*features).agg(F.countDistinct(label).alias("n_labels"), F.count("*").alias("n_rows"))
    return out.where("n_labels > 1")


def negative_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, negative): negative cells are counted and kept."""
    row = df.agg(*(F.count_if(F.col(c) < 0).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("negative")) for c in columns))
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def clean(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str]) -> DataFrame:
    """Rows with a label and some feature, non-finite cells null, exact repeats dropped."""
    labelled = df.where(F.col(label).isNotNull() & (F.trim(F.col(label)) != ""))
    return drop_duplicates(drop_empty(nulls_for_nonfinite(labelled, features), features), features, label, key)


def clean_report(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(measure, value) of what clean() does to df, in two aggregations."""
    cells = [F.count_if(F.abs(F.col(c)) == F.lit(INF)).alias(f"inf|{c}") for c in features]
    cells += [F.count_if(F.isnan(F.col(c)) | F.col(c).isNull()).alias(f"nan|{c}") for c in features]
    cells += [F.count_if(F.col(c) < 0).alias(f"neg|{c}") for c in features]
    empty = None
    for c in features:
        none = finite(F.col(c)).isNull()
        empty = none if empty is None else empty & none
    row = df.agg(F.count("*").alias("rows"), F.count_if(empty).alias("empty"), *cells)
    kept = drop_empty(nulls_for_nonfinite(df, features), features).groupBy(*features, label).agg(F.count("*").alias("n"))
    kept = kept.agg(F.count("*").alias("rows_out"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    total = lambda kind: sum((F.col(f"`{kind}|{c}`") for c in features), F.lit(0))
    measures = {
        "rows_in": F.col("rows"), "rows_out": F.col("rows_out"), "duplicates": F.col("duplicates"), "all_missing": F.col("empty"),
        "infinite": total("inf"), "missing": total("nan"), "negative": total("neg"),
        **{f"missing:{c}": F.col(f"`nan|{c}`") + F.col(f"`inf|{c}`") for c in features},
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("measure"), v.cast("long").alias("value")) for k, v in measures.items()))
    return row.crossJoin(kept).select(F.explode(pairs).alias("x")).select("x.*")


def load_report(df: DataFrame, features: Sequence[str], label: str, classes: Sequence[str]) -> DataFrame:
    """(kind, name, n): rows, infinite, NaN and null cells by feature, rows by class, unexpected labels."""
    measures = {("rows", ""): F.count("*"), ("unlabelled", ""): F.count_if(F.col(label).isNull())}
    for c in features:
        measures["infinite", c] = F.count_if(F.abs(F.col(c)) == F.lit(INF))
        measures["nan", c] = F.count_if(F.isnan(F.col(c)))
        measures["null", c] = F.count_if(F.col(c).isNull())
    row = df.agg(*(m.alias(f"{a}|{b}") for (a, b), m in measures.items()))
    pairs = F.array(*(F.struct(F.lit(a).alias("kind"), F.lit(b).alias("name"), F.col(f"`{a}|{b}`").cast("long").alias("n")) for a, b in measures))
    kind = F.when(F.col(label).isin(*classes), F.lit("class")).otherwise(F.lit("unexpected"))
    labels = df.where(F.col(label).isNotNull()).groupBy(kind.alias("kind"), F.col(label).alias("name")).agg(F.count("*").alias("n"))
    return row.select(F.explode(pairs).alias("x")).select("x.*").unionByName(labels)


def audit_counts(df: DataFrame, label: str, published: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Class counts against published ones: signed share of difference and ok, CHECK or unlisted."""
    own = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    out = own.join(published, "class", "full").select("class", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "published")
    gap = F.try_divide((F.col("n") - F.col("published")).cast("double"), F.col("published").cast("double"))
    verdict = F.when(F.col("published").isNull(), "unlisted").when(F.abs(gap) <= tolerance, "ok").otherwise("CHECK")
    return out.select("class", "n", "published", F.bround(gap, 6).alias("difference"), verdict.alias("verdict"))
