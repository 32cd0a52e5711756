"""Headers, labels and cells in canonical form."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.local import local_table
from flowlens.sources import dims

#: Characters that stand for a dash in labels.
DASHES = "\u0096\u0097‐‑‒–—―−�"


def column_name(name: str) -> str:
    """A header without outer blanks or runs of blanks; a no-break space is a blank."""
    return re.sub(r"\s+", " ", str(name).replace("\xa0", " ").strip())


def canonical_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df under canonical headers, the first of equal ones kept; and the headers that collided."""
    names = [column_name(c) for c in df.columns]
    positional = df.toDF(*(f"_{i}" for i in range(len(names))))
    first = {n: i for i, n in reversed(list(enumerate(names)))}
    out = positional.select(*(F.col(f"_{i}").alias(n) for n, i in sorted(first.items(), key=lambda x: x[1])))
    return out, [n for i, n in enumerate(names) if first[n] != i]


def drop_identifiers(df: DataFrame, identifiers: dict[str, str] = dims.IDENTIFIERS) -> tuple[DataFrame, dict[str, str]]:
    """df without identifier, unnamed and index columns; and why each went."""
    gone = {}
    for c in df.columns:
        low = c.strip().lower()
        if low in identifiers:
            gone[c] = identifiers[low]
        elif low.startswith("unnamed:") or low == "index":
            gone[c] = "not data"
    return df.drop(*gone), gone


def fold(c: Column) -> Column:
    """The key by which labels are looked up: no blanks or underscores, lower case."""
    return F.lower(F.regexp_replace(c, r"[\s_]+", ""))


def clean_label(c: Column) -> Column:
    """Dashes, blanks and hyphenated names in one form; text should be NFKC."""
    text = F.regexp_replace(F.replace(c, F.lit("\xa0"), F.lit(" ")), f"[{DASHES}]+", "-")
    text = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\s*-\s*", " - ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.regexp_replace(text, r"(?i)\b(FTP|SSH)\s+-\s+(Patator)\b", "$1-$2")


def label_table(df: DataFrame, label: str) -> DataFrame:
    """(raw, canonical) of the distinct labels of df.

    Compatibility forms (NFKC) are the one step without a built-in function; only distinct labels
    go through it. Unknown labels stay in cleaned form; null and blank ones become null.
    """

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    spark = df.sparkSession
    squeeze = lambda s: re.sub(r"[\s_]+", "", s).lower()
    known = {squeeze(x): x for x in dims.RAW_COUNTS} | {squeeze(k): v for k, v in dims.VARIANTS.items()}
    lookup = local_table(spark, list(known.items()), "folded string, canonical string")
    raw = df.select(F.col(label).alias("raw")).where(F.col("raw").isNotNull()).distinct()
    cleaned = raw.withColumn("cleaned", clean_label(nfkc("raw"))).withColumn("folded", fold(F.col("cleaned")))
    joined = cleaned.join(F.broadcast(lookup), "folded", "left")
    return joined.select("raw", F.when(F.col("cleaned") != "", F.coalesce("canonical", "cleaned")).alias("canonical"))


def normalise_labels(df: DataFrame, label: str, merge_rare: bool = True) -> DataFrame:
    """df with canonical labels; null where the label is null or blank.

    The table of distinct labels is broadcast: a class may hold most rows, and a join by label would sort it in one task."""
    table = label_table(df, label)
    out = df.join(F.broadcast(table), df[label] == table["raw"], "left")
    value = merged(F.col("canonical")) if merge_rare else F.col("canonical")
    return out.select(*(value.alias(c) if c == label else df[c] for c in df.columns))


def merged(c: Column, rare: Sequence[str] = tuple(dims.RARE_SOURCES), into: str = dims.RARE) -> Column:
    """Labels with the rare ones as one class."""
    return F.when(c.isin(*rare), F.lit(into)).otherwise(c)


def with_family(df: DataFrame, label: str, profiles: DataFrame) -> DataFrame:
    """df with family, Unknown where the class is."""
    table = profiles.select(F.col("class").alias("_class"), F.col("family").alias("_family"))
    out = df.join(F.broadcast(table), df[label] == table["_class"], "left")
    return out.select(*(df[c] for c in df.columns), F.coalesce("_family", F.lit(dims.UNKNOWN_FAMILY)).alias("family"))


def numbers(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Text cells as doubles: junk as null, `Infinity` as infinite."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in features})


def coerced_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, coerced, nonfinite): cells that are no number, or infinite; nulls count as neither."""
    measures = []
    for c in features:
        x = F.expr(f"try_cast(`{c}` as double)")
        measures.append(F.count_if(F.col(c).isNotNull() & (x.isNull() | F.isnan(x))).alias(f"{c}|coerced"))
        measures.append(F.count_if(F.abs(x) == F.lit(float("inf"))).alias(f"{c}|nonfinite"))
    row = df.agg(*measures)
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}|coerced`").alias("coerced"), F.col(f"`{c}|nonfinite`").alias("nonfinite")) for c in features))
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def encode(df: DataFrame, label: str, codec: DataFrame) -> DataFrame:
    """df with code, null where the class is not in the codec."""
    table = codec.select(F.col("class").alias("_class"), "code")
    out = df.join(F.broadcast(table), df[label] == table["_class"], "left")
    return out.select(*(df[c] for c in df.columns), "code")


def unseen(df: DataFrame, label: str, codec: DataFrame) -> DataFrame:
    """(class, n) of the labels that are not in the codec."""
    out = df.where(F.col(label).isNotNull()).join(F.broadcast(codec), df[label] == codec["class"], "left_anti")
    return out.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))


def missing_and_extra(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """Features without a column, columns without a feature; an error if no feature is there."""
    missing = [f for f in features if f not in df.columns]
    if len(missing) == len(features):
        raise ValueError("no known feature in the table")
    return missing, [c for c in df.columns if c not in set(features)]
