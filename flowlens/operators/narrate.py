"""Words for numbers, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.portable import apart
from flowlens.sources import dims


def _ladder(c: Column, steps: Sequence[tuple[float, str]], rest: str) -> Column:
    out = None
    for least, word in steps:
        out = F.when(c >= least, word) if out is None else out.when(c >= least, word)
    return out.otherwise(rest)


def confidence_phrase(p: Column) -> Column:
    """Phrases by least confidence."""
    steps = [(0.99, "almost certainly"), (0.9, "very likely"), (0.7, "likely"), (0.5, "probably"), (0.3, "possibly")]
    return _ladder(p, steps, "weakly suggestive of")


def severity_word(s: Column) -> Column:
    """Words of severity 1 to 5."""
    words = ["informational", "low", "medium", "high", "critical"]
    return F.coalesce(F.get(F.array(*(F.lit(w) for w in words)), s.cast("int") - 1), F.lit("unknown"))


def level(v: Column) -> Column:
    """A standardised value in words. The words and their bounds."""
    return F.when(v >= 2, "far above normal").when(v >= 0.75, "above normal").when(v <= -2, "far below normal").when(v <= -0.75, "below normal").otherwise("close to normal")


def calibration_verdict(ece: Column) -> Column:
    """Words by bound of the error."""
    return F.when(ece < 0.05, "well calibrated").when(ece < 0.15, "somewhat overconfident").otherwise("poorly calibrated")


def ambiguity(verdicts: DataFrame, profiles: DataFrame) -> DataFrame:
    """verdicts with ambiguous (a runner-up above .15 within .25) and known_confusable."""
    near = (F.col("runner_up_confidence") > 0.15) & (F.col("confidence") - F.col("runner_up_confidence") < 0.25)
    table = profiles.select(F.col("class").alias("_class"), F.col("confusable").alias("_confusable"))
    out = verdicts.join(F.broadcast(table), F.col("prediction") == F.col("_class"), "left").withColumn("ambiguous", near)
    return out.withColumn("known_confusable", F.col("ambiguous") & F.coalesce(F.array_contains("_confusable", F.col("runner_up")), F.lit(False))).drop("_class", "_confusable")


def with_profiles(verdicts: DataFrame, profiles: DataFrame) -> DataFrame:
    """verdicts with family, severity word, tactic and action of the prediction; defaults if unknown."""
    table = profiles.select(F.col("class").alias("_class"), F.col("family").alias("_f"), F.col("severity").alias("_s"), F.col("tactic").alias("_t"), F.col("action").alias("_a"))
    out = verdicts.join(F.broadcast(table), F.col("prediction") == F.col("_class"), "left")
    severity = F.coalesce("_s", F.lit(dims.UNKNOWN_SEVERITY))
    return out.select(*(F.col(c) for c in verdicts.columns), F.coalesce("_f", F.lit(dims.UNKNOWN_FAMILY)).alias("family"), severity_word(severity).alias("severity_word"), F.coalesce("_t", F.lit("")).alias("tactic"), F.coalesce("_a", F.lit(dims.UNKNOWN_ACTION)).alias("action"))


def _part(name: Column, value: Column) -> Column:
    return F.concat(F.lit("the "), name, F.lit(" ("), level(value), F.lit(")"))


def _sentence(verdicts: DataFrame, key: Sequence[str], reasons: Column, profiles: DataFrame | None) -> DataFrame:
    percent = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    text = F.concat(F.lit("This record is "), confidence_phrase(F.col("confidence")), F.lit(" "), F.col("prediction"), F.lit(" ("), percent("confidence"), F.lit(")"))
    text = F.concat(text, F.coalesce(F.concat(F.lit(", resting on "), reasons), F.lit("")), F.lit("."))
    if profiles is not None:
        verdicts = with_profiles(ambiguity(verdicts, profiles), profiles)
        confused = F.when(F.col("known_confusable"), F.lit(", which is often taken for it")).otherwise(F.lit(""))
        other = F.concat(F.lit(" "), F.col("runner_up"), F.lit(" is nearly as likely ("), percent("runner_up_confidence"), F.lit(")"), confused, F.lit("."))
        text = F.concat(text, F.lit(" Severity: "), F.col("severity_word"), F.lit("."), F.when(F.col("ambiguous"), other).otherwise(F.lit("")), F.lit(" Next: "), F.col("action"))
    return verdicts.select(*key, text.alias("sentence"))


def sentences(verdicts: DataFrame, contributions: DataFrame, glosses: DataFrame, key: Sequence[str], profiles: DataFrame | None = None) -> DataFrame:
    """(key, sentence) from a verdict and its ranked contributions (feature, place, value standardised).

    With profiles (and runner_up and runner_up_confidence in the verdicts) also how severe it is, a
    runner-up that is nearly as likely and whether the two are known to be confused, and the next step.
    """
    named = contributions.join(F.broadcast(glosses), "feature", "left")
    part = _part(F.coalesce("gloss", "feature"), F.col("value"))
    reasons = named.withColumn("part", part).groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), ", ").alias("reasons"))
    return _sentence(verdicts.join(reasons, list(key), "left"), key, F.col("reasons"), profiles)


def told(verdicts: DataFrame, glosses: DataFrame, key: Sequence[str], profiles: DataFrame | None = None) -> DataFrame:
    """sentences() of verdicts that carry their reasons (explain.top_reasons): a row at a time, without a join by key."""
    table = [F.lit(x) for r in glosses.select("feature", "gloss").collect() for x in (r["feature"], r["gloss"])]  # a feature has a row
    name = lambda f: F.coalesce(F.element_at(F.create_map(*table), f), f) if table else f
    parts = F.filter(F.transform("reasons", lambda r: _part(name(r["feature"]), r["value"])), lambda p: p.isNotNull())
    verdicts = verdicts.withColumn("reasons", F.when(F.size("reasons") > 0, F.array_join(parts, ", ")))
    return _sentence(apart(verdicts), key, F.col("reasons"), profiles)
