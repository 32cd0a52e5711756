"""Explanations of scored rows. Every variant of every row is scored in one pass; the number of rows
grows by the number of features, so take a bounded sample first."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.portable import apart, key_hash, numbered, ratio
from flowlens.operators.evaluate import predicted

Scorer = Callable[[DataFrame], DataFrame]


def background(df: DataFrame, features: Sequence[str], key: Sequence[str], n: int, seed: str = "background", label: str | None = None) -> tuple[DataFrame, dict[str, float]]:
    """n rows by hash order (n a class if a label is given) and their medians."""
    if label is None:
        rows = df.orderBy(key_hash(seed, key), *key).limit(n)
    else:
        from flowlens.operators.sample import capped, class_counts

        rows = capped(df, label, key, dict.fromkeys(class_counts(df, label), n), seed)
    got = rows.agg(*(F.percentile(F.col(f), 0.5).alias(f) for f in features)).first()
    return rows, {f: float(got[f] or 0.0) for f in features}


def log_odds(p: Column, edge: float = 1e-12) -> Column:
    """Log odds of probabilities held `edge` from 0 and 1."""
    q = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.ln(q / (1 - q))


def occlusion_columns(df: DataFrame, features: Sequence[str], key: Sequence[str], score: Scorer, medians: dict[str, float], target: int | None = None, edge: float = 1e-12) -> DataFrame:
    """(key, _v0 and so on, _c0 and so on): the values of the features and their contributions, a row a
    record. Narrow: a row's variants are scored one after the other beside it, so nothing is exploded and
    brought together again. score keeps the columns it gets and adds proba."""
    features = list(features)
    value = [f"_v{i}" for i in range(len(features))]
    rows = df.select(*key, *(F.col(f).cast("double").alias(n) for f in features for n in (f, value[features.index(f)])))
    want = F.lit(target) if target is not None else predicted()
    out = score(apart(rows)).withColumn("_k", want).withColumn("_base", log_odds(F.element_at("proba", F.col("_k") + 1), edge)).drop("proba")
    for i, f in enumerate(features):
        out = score(apart(out).withColumn(f, F.lit(float(medians[f])))).withColumn(f"_c{i}", F.col("_base") - log_odds(F.element_at("proba", F.col("_k") + 1), edge))
        out = out.withColumn(f, F.col(value[i])).drop("proba")
    return apart(out.select(*key, *value, *(f"_c{i}" for i in range(len(features)))))


def occlusion(df: DataFrame, features: Sequence[str], key: Sequence[str], score: Scorer, medians: dict[str, float], target: int | None = None, edge: float = 1e-12) -> DataFrame:
    """(key, feature, contribution, value): the fall in log odds of the target class when the feature
    takes its median. target: a class code; by default each row's predicted class."""
    out = occlusion_columns(df, features, key, score, medians, target, edge)
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"_c{i}").alias("contribution"), F.col(f"_v{i}").alias("value")) for i, f in enumerate(features)))
    return out.select(*key, F.explode(cells).alias("_x")).select(*key, "_x.*")


def wide_occlusion(df: DataFrame, features: Sequence[str], key: Sequence[str], score: Scorer, medians: dict[str, float], target: int | None = None, edge: float = 1e-12) -> DataFrame:
    """occlusion() as a row a record: key, and each feature's contribution under its name."""
    return occlusion_columns(df, features, key, score, medians, target, edge).select(*key, *(F.col(f"_c{i}").alias(f) for i, f in enumerate(features)))


def top_reasons(
    df: DataFrame, features: Sequence[str], key: Sequence[str], score: Scorer, medians: dict[str, float], n: int, target: int | None = None, edge: float = 1e-12, digits: int = 9,
    shown: Callable[[str, Column], Column] = lambda f, v: v,
) -> DataFrame:
    """(key, reasons): the n largest contributions of each record by size, in order, as structs of place,
    feature, contribution, value (as shown() gives it) and direction: ranked_contributions() within each row."""
    out = occlusion_columns(df, features, key, score, medians, target, edge)
    size = lambda i: F.coalesce(-F.round(F.abs(F.col(f"_c{i}")), digits), F.lit(float("inf")))
    cells = F.array(*(F.struct(size(i).alias("size"), F.lit(f).alias("feature"), F.col(f"_c{i}").alias("contribution"), shown(f, F.col(f"_v{i}")).alias("value")) for i, f in enumerate(features)))
    out = out.withColumn("_s", F.sort_array(cells))
    side = lambda c: F.when(c > 0, "supports").when(c < 0, "opposes").otherwise("neutral")
    each = lambda i: F.struct(F.lit(i + 1).alias("place"), *(F.col("_s")[i][c].alias(c) for c in ("feature", "contribution", "value")), side(F.col("_s")[i]["contribution"]).alias("direction"))
    return apart(out).select(*key, F.array(*(each(i) for i in range(min(n, len(features))))).alias("reasons"))


def ranked_contributions(contributions: DataFrame, key: Sequence[str], n: int, digits: int = 9) -> DataFrame:
    """The n largest contributions of each row by size, with place and direction."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.round(F.abs("contribution"), digits)), "feature"))
    side = F.when(F.col("contribution") > 0, "supports").when(F.col("contribution") < 0, "opposes").otherwise("neutral")
    return contributions.withColumn("place", place).where(F.col("place") <= n).withColumn("direction", side)


def global_importance(contributions: DataFrame, label: str) -> DataFrame:
    """(label, feature, importance): mean size of the contributions, by class."""
    return contributions.groupBy(label, "feature").agg(F.avg(F.abs("contribution")).alias("importance"))


def importance_shares(by_class: DataFrame, digits: int = 9) -> DataFrame:
    """(feature, importance, position, share, cumulative): summed over the classes; a row a feature."""
    total = by_class.groupBy("feature").agg(F.sum("importance").alias("importance"))
    order = Window.orderBy(F.desc(F.round("importance", digits)), "feature")
    share = ratio(F.col("importance"), F.sum("importance").over(Window.partitionBy()))
    out = total.withColumn("share", share).withColumn("position", F.row_number().over(order))
    return out.withColumn("cumulative", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def signatures(by_class: DataFrame, label: str, n: int, digits: int = 9) -> DataFrame:
    """(label, feature, ratio, place): features that matter more to a class than to classes on average."""
    mean = F.avg("importance").over(Window.partitionBy("feature"))
    out = by_class.withColumn("ratio", ratio(F.col("importance"), mean))
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.desc(F.round("ratio", digits)), "feature"))
    return out.withColumn("place", place).where(F.col("place") <= n).select(label, "feature", "ratio", "place")


def measured(scored: DataFrame, by: Sequence[str], code: str, metric: str) -> DataFrame:
    """(by, value): accuracy, balanced_accuracy, macro_f1 or log_loss of each group of scored rows."""
    if metric == "log_loss":
        own = F.least(F.greatest(F.element_at("proba", F.col(code) + 1), F.lit(1e-15)), F.lit(1.0))
        return scored.groupBy(*by).agg(F.avg(-F.ln(own)).alias("value"))
    n = scored.groupBy(*by, F.col(code).alias("_y"), predicted().alias("_p")).agg(F.count("*").alias("n"))
    said = n.groupBy(*by, F.col("_p").alias("_y")).agg(F.sum("n").alias("said"))
    hit = F.sum(F.when(F.col("_y") == F.col("_p"), F.col("n")).otherwise(0)).alias("tp")
    classes = n.groupBy(*by, "_y").agg(F.sum("n").alias("n"), hit).join(said, [*by, "_y"], "left").na.fill(0, ["said"])
    value = {"accuracy": F.sum("tp") / F.sum("n"), "balanced_accuracy": F.avg(F.col("tp") / F.col("n")), "macro_f1": F.avg(2 * F.col("tp") / (F.col("n") + F.col("said")))}[metric]
    return classes.groupBy(*by).agg(value.alias("value"))


#: Rounds of the bijection, and how often a number outside the rows is walked on.
ROUNDS, WALK = 6, 16


@functools.lru_cache(maxsize=4 * ROUNDS)
def _shifts(seed: str, repeat: int, j: int, n: int) -> np.ndarray:
    """The shift of a round for each value, from 0 to n - 1, of the other coordinate: 32 bits of MD5."""
    return np.array([int(hashlib.md5(f"{seed}|{repeat}|{j}|{v}".encode()).hexdigest()[:8], 16) for v in range(n)], np.int64)


def _partners(number: np.ndarray, n: int, seed: str, repeat: int) -> np.ndarray:
    across = math.isqrt(max(n - 1, 0)) + 1
    down = max(1, -(-n // across))
    x, y = number % across, number // across
    at = np.arange(len(number))
    for _ in range(WALK):
        for j in range(0, ROUNDS, 2):
            x[at] = (x[at] + _shifts(seed, repeat, j, down)[y[at]]) % across
            y[at] = (y[at] + _shifts(seed, repeat, j + 1, across)[x[at]]) % down
        at = at[x[at] + y[at] * across >= n]
        if not len(at):
            return x + y * across
    raise ValueError("no partner within the walk")


def partner(number: Column, n: int, seed: str, repeat: Column) -> Column:
    """Another number from 0 to n - 1 for each: a bijection by seed and repeat, computed row by row.

    A number is a place in a grid of about sqrt(n) by sqrt(n); rounds shift one coordinate by a hash of
    the other, which can be undone. A coordinate has about sqrt(n) values, so a worker hashes each once and
    looks shifts up. The grid has fewer than sqrt(n) places too many; from one of those the
    rounds are walked again until a number of a row is met. That takes WALK passes at most up to 256 rows
    and, beyond, with odds of n^(-WALK / 2) of failing, which is an error.
    """

    @F.pandas_udf("long")
    def run(numbers: pd.Series, repeats: pd.Series) -> pd.Series:
        out = np.zeros(len(numbers), np.int64)
        for r in repeats.unique():
            own = (repeats == r).to_numpy()
            out[own] = _partners(numbers.to_numpy()[own], n, seed, int(r))
        return pd.Series(out)

    return run(number.cast("long"), repeat.cast("long"))


def permuted(df: DataFrame, features: Sequence[str], key: Sequence[str], code: str, repeats: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(the rows; repeat, feature, code, features): every row once for each feature and repeat, with that
    feature's value from its partner. Rows are numbered by key, code and values in ranges; one join
    brings a partner's whole row, so all features of a repeat move alike, each on its own."""
    rows = df.select(*key, code, *(F.col(f).cast("double").alias(f) for f in features))
    placed = numbered(rows, [*key, code, *features], "_i", [code, *features])
    n = placed.count()
    asked = placed.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("_p", partner(F.col("_i"), n, seed, F.col("repeat"))).drop("_i")
    other = placed.select(F.col("_i").alias("_p"), *(F.col(f).alias(f"_v{k}") for k, f in enumerate(features)))
    pairs = asked.join(other, "_p").withColumn("feature", F.explode(F.array(*(F.lit(f) for f in features))))
    moved = [F.when(F.col("feature") == f, F.col(f"_v{k}")).otherwise(F.col(f)).alias(f) for k, f in enumerate(features)]
    return rows, pairs.select("repeat", "feature", code, *moved)


def permutation_importance(
    df: DataFrame, features: Sequence[str], key: Sequence[str], code: str, score: Scorer, repeats: int = 3, seed: str = "permute", metric: str = "accuracy",
) -> DataFrame:
    """(feature, raw_drop, importance): how much worse a metric of measured() gets when a feature's values
    change places over all rows, mean over repeats; importance is 0 where it would be negative."""
    rows, variants = permuted(df, features, key, code, repeats, seed)
    base = measured(score(rows).withColumn("_one", F.lit(1)), ["_one"], code, metric).select(F.col("value").alias("b"))
    hits = measured(score(variants), ["feature", "repeat"], code, metric).groupBy("feature").agg(F.avg("value").alias("a"))
    drop = F.col("a") - F.col("b") if metric == "log_loss" else F.col("b") - F.col("a")
    return hits.crossJoin(F.broadcast(base)).select("feature", drop.alias("raw_drop"), F.greatest(drop, F.lit(0.0)).alias("importance"))


def recall_drop(df: DataFrame, features: Sequence[str], key: Sequence[str], code: str, score: Scorer, seed: str = "permute") -> DataFrame:
    """(feature, code, drop): the fall in each class's recall over all rows, one repeat."""
    rows, variants = permuted(df, features, key, code, 1, seed)
    right = F.avg((predicted() == F.col(code)).cast("double"))
    base = score(rows).groupBy(code).agg(right.alias("b"))
    hits = score(variants).groupBy("feature", code).agg(right.alias("a"))
    return hits.join(base, code).select("feature", code, (F.col("b") - F.col("a")).alias("drop"))


def linear_contributions(df: DataFrame, features: Sequence[str], key: Sequence[str], coefficients: Sequence[float], means: dict[str, float]) -> DataFrame:
    """(key, feature, contribution) on the margin of a linear model: coefficient * (value - mean). They
    add up, with the margin at the means, to the row's margin exactly."""
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), (F.lit(float(w)) * (F.col(f) - means[f])).alias("contribution")) for f, w in zip(features, coefficients, strict=True)))
    return df.select(*key, F.explode(cells).alias("_c")).select(*key, "_c.*")
