"""Tables an analyst works from, over a verdict table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.local import local_table
from flowlens.functions.portable import ratio, rounded
from flowlens.sources import dims


def class_totals(verdicts: DataFrame, codec: DataFrame) -> DataFrame:
    """(class, code, n) of predictions in class order, zeros included."""
    n = verdicts.groupBy(F.col("prediction").alias("class")).agg(F.count("*").alias("n"))
    return codec.join(n, "class", "left").select("class", "code", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def overview(verdicts: DataFrame, benign: str, critical: int = 5) -> DataFrame:
    """One row: rows, attacks by threshold and by label, their gap and shares, confidence, reviews, classes."""
    label = F.col("prediction") != benign
    row = verdicts.agg(
        F.count("*").alias("rows"), F.count_if("is_attack").alias("attacks_by_threshold"), F.count_if(label).alias("attacks_by_label"),
        rounded(F.avg("confidence")).alias("mean_confidence"), rounded(F.percentile("confidence", 0.5)).alias("median_confidence"),
        F.count_if(F.col("status") == "review").alias("needs_review"), F.countDistinct("prediction").alias("classes"), F.count_if(F.col("severity") >= critical).alias("critical"),
    )
    return row.select(
        "*", (F.col("attacks_by_threshold") - F.col("attacks_by_label")).alias("gap"),
        rounded(ratio(F.col("attacks_by_threshold"), F.col("rows"))).alias("threshold_share"), rounded(ratio(F.col("attacks_by_label"), F.col("rows"))).alias("label_share"),
    )


def reconciliation(verdicts: DataFrame, benign: str) -> DataFrame:
    """Attacks by threshold and by label, their gap, and where to move the threshold to close it."""
    row = overview(verdicts, benign).select("attacks_by_threshold", "attacks_by_label", "gap")
    return row.withColumn("hint", F.when(F.col("gap") > 0, "raise").when(F.col("gap") < 0, "lower").otherwise("none"))


def triage(verdicts: DataFrame, profiles: DataFrame, benign: str) -> DataFrame:
    """Classes other than the benign one by severity, then count: priority, confidence, reviews, action."""
    groups = verdicts.where(F.col("prediction") != benign).groupBy(F.col("prediction").alias("class")).agg(
        F.count("*").alias("n"), rounded(F.avg("confidence")).alias("mean_confidence"), F.count_if(F.col("status") == "review").alias("needs_review"), F.max("severity").alias("severity")
    )
    table = profiles.select("class", "action")
    out = groups.join(F.broadcast(table), "class", "left")
    place = F.row_number().over(Window.orderBy(F.desc("severity"), F.desc("n"), "class"))
    return out.select(place.alias("priority"), "class", "severity", "n", "mean_confidence", "needs_review", F.coalesce("action", F.lit(dims.UNKNOWN_ACTION)).alias("action"))


def distribution(verdicts: DataFrame) -> DataFrame:
    """(class, n, share, mean_confidence, severity) of the classes that were predicted."""
    groups = verdicts.groupBy(F.col("prediction").alias("class")).agg(F.count("*").alias("n"), rounded(F.avg("confidence")).alias("mean_confidence"), F.max("severity").alias("severity"))
    return groups.withColumn("share", rounded(ratio(F.col("n"), F.sum("n").over(Window.partitionBy()))))


def confidence_histogram(verdicts: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, is_attack, n) over [0, 1] in equal bins, the last one closed, empty ones included."""
    spark = verdicts.sparkSession
    at = F.coalesce(F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int"), F.lit(-1))
    n = verdicts.groupBy(at.alias("bin"), F.coalesce("is_attack", F.lit(False)).alias("is_attack")).agg(F.count("*").alias("n"))
    grid = local_table(spark, [(i,) for i in range(bins)], "bin int").select("bin", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_attack"))
    return grid.join(n, ["bin", "is_attack"], "left").select("bin", "is_attack", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_reference(profiles: DataFrame, recall: DataFrame) -> DataFrame:
    """Profiles with each class's recall, null where it was not measured."""
    return profiles.join(recall.select("class", "recall"), "class", "left")


def feature_reference(ranking: DataFrame, glosses: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """(feature, position, gloss, median, selected)."""
    out = ranking.join(F.broadcast(glosses), "feature", "left").join(F.broadcast(stats.select("feature", "raw_median")), "feature", "left")
    return out.select("feature", "position", F.coalesce("gloss", "feature").alias("gloss"), F.col("raw_median").alias("median"), (F.col("position") <= n).alias("selected"))


def majority_accuracy(df: DataFrame, label: str) -> DataFrame:
    """(class, accuracy) of always answering the largest class."""
    n = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    every = n.withColumn("total", F.sum("n").over(Window.partitionBy()))
    return every.orderBy(F.desc("n"), "class").limit(1).select("class", rounded(ratio(F.col("n"), F.col("total"))).alias("accuracy"))
