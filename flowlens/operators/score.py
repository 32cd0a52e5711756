"""Scoring: from any table to verdicts, one row each. Everything is narrow; a threshold is a column
expression over scored rows, so changing it scores nothing again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.portable import once, rounded
from flowlens.operators.normalise import canonical_columns, missing_and_extra, numbers
from flowlens.operators.prep import Stats, align, transform
from flowlens.sources import dims


def prepare(df: DataFrame, stats: Stats, keep: Sequence[str]) -> DataFrame:
    """keep and the model's features, ready to score: canonical headers, cells as numbers, absent
    features as medians. Only columns the model uses are touched; no row is lost."""
    named, _ = canonical_columns(df)
    missing_and_extra(named, [r.feature for r in stats.rows])
    there = [c for c in stats.features if c in named.columns]
    return transform(numbers(named, there), stats, keep)


def repairs(df: DataFrame, stats: Stats, label: str | None = None, classes: Sequence[str] = ()) -> DataFrame:
    """(kind, column, n): missing and extra columns, cells that are no number or not finite, labels that
    no class has, repeated headers."""
    named, collided = canonical_columns(df)
    missing, extra = missing_and_extra(named, [r.feature for r in stats.rows])
    extra = [c for c in extra if c != label]
    fixed = [("missing", c, 1) for c in missing] + [("extra", c, 1) for c in extra] + [("duplicate", c, 1) for c in collided]
    measures = {}
    for c in stats.features:
        if c in named.columns:
            x = F.expr(f"try_cast(`{c}` as double)")
            measures["coerced", c] = F.count_if(F.col(c).isNotNull() & (x.isNull() | F.isnan(x)))
            measures["nonfinite", c] = F.count_if(F.abs(x) == F.lit(float("inf")))
    if label in named.columns:
        measures["unknown_label", label] = F.count_if(F.col(label).isNotNull() & ~F.col(label).isin(*classes))
    row = named.agg(*(m.alias(f"{a}|{b}") for (a, b), m in measures.items()))
    pairs = [F.struct(F.lit(a).alias("kind"), F.lit(b).alias("column"), F.col(f"`{a}|{b}`").cast("long").alias("n")) for a, b in measures]
    pairs += [F.struct(F.lit(a).alias("kind"), F.lit(b).alias("column"), F.lit(n).cast("long").alias("n")) for a, b, n in fixed]
    return row.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def checked_proba(c: Column) -> Column:
    """Probabilities that sum to 1: negatives within rounding become 0, all zero becomes uniform, sums
    within rounding of 1 stay as they are; a negative or non-finite value raises an error."""
    bad = F.exists(c, lambda p: p.isNull() | F.isnan(p) | (p < -1e-9) | (p == F.lit(float("inf"))))
    part = F.transform(c, lambda p: F.greatest(p, F.lit(0.0)))
    total = F.aggregate(part, F.lit(0.0), lambda a, p: a + p)
    even = F.transform(part, lambda p: F.lit(1.0) / F.size(c))
    fine = F.when(total == 0, even).when(F.abs(total - 1) < 1e-9, part).otherwise(F.transform(part, lambda p: F.try_divide(p, total)))
    return F.when(bad, F.raise_error(F.lit("probabilities must be finite and not negative")).cast("array<double>")).otherwise(fine)


def ranked(proba: Column) -> Column:
    """Classes by falling probability, ties by code: structs of p (negated) and k."""
    return F.array_sort(F.transform(proba, lambda p, i: F.struct((-p).alias("p"), i.alias("k"))))


def verdicts(df: DataFrame, classes: Sequence[str], benign: str | None, proba: str = "proba", threshold: float = 0.5, confident: float = 0.6, keep: Sequence[str] = ()) -> DataFrame:
    """keep, code columns and: pred, confidence, runner_up, runner_up_confidence, attack_probability,
    is_attack (by threshold, whatever the class), status (ok or review)."""
    order = df.withColumn("_r", ranked(F.col(proba)))
    attack = 1 - F.element_at(F.col(proba), list(classes).index(benign) + 1) if benign in classes else F.lit(1.0)
    out = order.withColumns({
        "pred": F.col("_r")[0]["k"], "confidence": -F.col("_r")[0]["p"],
        "runner_up": F.get("_r", F.lit(1))["k"], "runner_up_confidence": -F.get("_r", F.lit(1))["p"], "attack_probability": attack,
    })
    out = out.withColumn("is_attack", F.col("attack_probability") >= threshold)
    return out.withColumn("status", F.when(F.col("confidence") < confident, "review").otherwise("ok")).drop("_r")


def verdict_table(scored: DataFrame, codec: DataFrame, profiles: DataFrame, key: Sequence[str], benign: str, top: int = 0, code: str | None = "code") -> DataFrame:
    """Verdicts by name with severity (0 for the benign class), rounded half-even to 6 digits; with
    true_class and correct where a code is there (null for an unknown label); alternatives to `top`."""
    names = F.create_map(*(x for r in codec.select("code", "class").collect() for x in (F.lit(r["code"]), F.lit(r["class"]))))  # a class has a row
    table = profiles.select(F.col("class").alias("_class"), "severity")
    name = lambda c: F.element_at(names, c.cast("int"))
    out = scored.withColumn("prediction", F.coalesce(name(F.col("pred")), F.lit(""))).join(F.broadcast(table), F.col("prediction") == F.col("_class"), "left")
    severity = F.when(F.col("prediction") == benign, 0).otherwise(F.coalesce("severity", F.lit(dims.UNKNOWN_SEVERITY)))
    columns = [
        *(F.col(k) for k in key), F.col("prediction"), rounded(F.col("confidence")).alias("confidence"),
        rounded(F.col("attack_probability")).alias("attack_probability"), F.col("is_attack"), severity.alias("severity"),
        name(F.col("runner_up")).alias("runner_up"), rounded(F.col("runner_up_confidence")).alias("runner_up_confidence"), F.col("status"),
    ]
    if code:
        columns += [name(F.col(code)).alias("true_class"), (F.col(code) == F.col("pred")).alias("correct")]
    for i in range(1, top):
        columns += [name(F.get(ranked(F.col("proba")), F.lit(i))["k"]).alias(f"alt{i}"), rounded(-F.get(ranked(F.col("proba")), F.lit(i))["p"]).alias(f"alt{i}_confidence")]
    return out.select(*columns)


def what_if(overrides: DataFrame, stats: Stats, key: Sequence[str]) -> DataFrame:
    """A row per record of (key, values map<string,double>): medians with the given values put in."""
    out = overrides.select(*key, *(F.coalesce(F.element_at("values", F.lit(f)), F.lit(None).cast("double")).alias(f) for f in stats.features))
    medians = {r.feature: r.raw_median for r in stats.rows}
    return align(out.withColumns({f: F.coalesce(F.col(f), F.lit(float(medians[f]))) for f in stats.features}), stats, key)


def queue(table: DataFrame, attacks: bool = False, review: bool = False, n: int | None = None, key: Sequence[str] = ()) -> DataFrame:
    """A view of verdicts by severity, then attack probability. The wanted rows are marked first: a filter on the
    columns themselves is pushed through all of the scoring and repeats it in every condition."""
    out = table
    if attacks or review:
        wanted = (F.col("is_attack") if attacks else F.lit(True)) & ((F.col("status") == "review") if review else F.lit(True))
        out = once(out, {"_wanted": wanted}).where("_wanted").drop("_wanted")
    out = out.orderBy(F.desc("severity"), F.desc("attack_probability"), *key)
    return out if n is None else out.limit(n)
