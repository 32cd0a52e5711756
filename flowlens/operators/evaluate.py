"""Evaluation of probability tables (key, code, proba).

Count metrics come from one shuffle on (code, predicted); curves from one on (class, score). Curves
need a global order: scores are cut into ranges by rank and summed within them, the totals of the ranges
above are added, and no task orders a whole class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.portable import ratio, rounded
from flowlens.operators.score import checked_proba
from flowlens.sources.stage import stored


def predicted(proba: str = "proba") -> Column:
    """The code of the largest probability, the lowest of ties; -1 without probabilities.

    Never null, so that a join on it adds no filter that computes the probabilities again.
    """
    return F.coalesce((F.array_position(F.col(proba), F.array_max(F.col(proba))) - 1).cast("int"), F.lit(-1))


def known(df: DataFrame, code: str = "code") -> DataFrame:
    """Rows whose label is a known class; the others count as unknown and are not evaluated."""
    return df.where(F.col(code).isNotNull())


def unknown_count(df: DataFrame, code: str = "code") -> DataFrame:
    return df.agg(F.count_if(F.col(code).isNull()).alias("unknown"), F.count("*").alias("rows"))


def confusion(df: DataFrame, codec: DataFrame, code: str = "code", proba: str = "proba") -> DataFrame:
    """(code, pred, n) of all pairs of classes, zeros included."""
    n = known(df, code).groupBy(F.col(code).alias("code"), predicted(proba).alias("pred")).agg(F.count("*").alias("n"))
    grid = codec.select("code").crossJoin(F.broadcast(codec.select(F.col("code").alias("pred"))))
    return grid.join(n, ["code", "pred"], "left").select("code", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def normalised(cm: DataFrame) -> DataFrame:
    """The confusion matrix with each row as shares."""
    return cm.withColumn("share", rounded(ratio(F.col("n"), F.sum("n").over(Window.partitionBy("code")))))


def per_class(cm: DataFrame) -> DataFrame:
    """(code, support, predicted, tp, fp, fn, precision, recall, f1), 0 where undefined."""
    diagonal = F.sum(F.when(F.col("code") == F.col("pred"), F.col("n")).otherwise(0))
    rows = cm.groupBy("code").agg(F.sum("n").alias("support"), diagonal.alias("tp"))
    columns = cm.groupBy(F.col("pred").alias("code")).agg(F.sum("n").alias("predicted"))
    out = rows.join(columns, "code")
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    f1 = ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))
    return out.select("code", "support", "predicted", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def averages(classes: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted precision, recall and F1 over the classes with support."""
    there, n = classes.where("support > 0"), F.sum("support")
    weighted = lambda c: rounded(ratio(F.sum(F.col(c) * F.col("support")), n)).alias(f"weighted_{c}")
    macro = lambda c: rounded(F.avg(c)).alias(f"macro_{c}")
    return there.agg(rounded(ratio(F.sum("tp"), n)).alias("accuracy"), rounded(F.avg("recall")).alias("balanced_accuracy"), *(f(c) for c in ("precision", "recall", "f1") for f in (macro, weighted)))


def most_confused(cm: DataFrame) -> DataFrame:
    """(code, confused_with, n): the class that most of a class's errors go to."""
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "pred"))
    return cm.where("code != pred and n > 0").withColumn("place", place).where("place = 1").select("code", F.col("pred").alias("confused_with"), "n")


def absent(classes: DataFrame) -> DataFrame:
    """(code, problem): classes without rows, and classes never predicted."""
    problem = F.when(F.col("support") == 0, "absent").when(F.col("predicted") == 0, "never predicted")
    return classes.select("code", problem.alias("problem")).where("problem is not null")


def top_k_accuracy(df: DataFrame, ks: Sequence[int] = (1, 2, 3), code: str = "code", proba: str = "proba") -> DataFrame:
    """(k, accuracy): rows whose class is among the k likeliest, ties by code."""
    own = F.element_at(F.col(proba), F.col(code) + 1)
    above = F.size(F.filter(F.transform(F.col(proba), lambda p, i: (p > own) | ((p == own) & (i < F.col(code)))), lambda x: x))
    row = known(df, code).select(above.alias("above")).agg(*(rounded(ratio(F.count_if(F.col("above") < k), F.count("*"))).alias(f"k{k}") for k in ks))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("accuracy")) for k in ks))).alias("x")).select("x.*")


def log_loss(df: DataFrame, code: str = "code", proba: str = "proba") -> DataFrame:
    own = F.least(F.greatest(F.element_at(F.col(proba), F.col(code) + 1), F.lit(1e-15)), F.lit(1.0))
    return known(df, code).agg(rounded(F.avg(-F.ln(own))).alias("log_loss"))


def agreement(cm: DataFrame) -> DataFrame:
    """(mcc, kappa) of a confusion matrix, 0 where undefined."""
    d = lambda c: c.cast("double")
    rows = cm.groupBy("code").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("code") == F.col("pred"), F.col("n")).otherwise(0)).alias("c"))
    both = rows.join(cm.groupBy(F.col("pred").alias("code")).agg(F.sum("n").alias("p")), "code")
    s = both.agg(d(F.sum("t")).alias("s"), d(F.sum("c")).alias("c"), F.sum(d(F.col("t")) * d(F.col("p"))).alias("tp"), F.sum(d(F.col("t")) ** 2).alias("tt"), F.sum(d(F.col("p")) ** 2).alias("pp"))
    mcc = ratio(F.col("c") * F.col("s") - F.col("tp"), F.sqrt((F.col("s") ** 2 - F.col("pp")) * (F.col("s") ** 2 - F.col("tt"))))
    kappa = ratio(ratio(F.col("c"), F.col("s")) - ratio(F.col("tp"), F.col("s") ** 2), 1 - ratio(F.col("tp"), F.col("s") ** 2))
    return s.select(rounded(mcc).alias("mcc"), rounded(kappa).alias("kappa"))


def calibration(df: DataFrame, bins: int = 10, code: str = "code", proba: str = "proba") -> DataFrame:
    """(bin, n, confidence, accuracy) of right-closed bins of confidence."""
    top = F.array_max(F.col(proba))
    at = sum((F.when(top > F.lit(i / bins), 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    right = (predicted(proba) == F.col(code)).cast("double")
    return known(df, code).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(top).alias("confidence"), F.avg(right).alias("accuracy"))


def calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("confidence") - F.col("accuracy")) * F.col("n")
    return bins.agg(rounded(ratio(F.sum(gap), F.sum("n"))).alias("ece"))


def score_table(df: DataFrame, by: Sequence[str], score: str, positive: str) -> DataFrame:
    """(by, score, pos, neg): rows and positives of each distinct score."""
    hit = F.col(positive).cast("int")
    return df.groupBy(*by, score).agg(F.sum(hit).cast("long").alias("pos"), F.sum(1 - hit).cast("long").alias("neg"))


def by_ranges(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """df, stored, with _slice: its range of (by, score), rising. Ranges are cut by rank, so they hold about
    as many rows each however close the scores lie."""
    return stored(df.repartitionByRange(*by, score).withColumn("_slice", F.spark_partition_id()), "scores")


def cumulated(scores: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """A score table with cum_pos and cum_neg: rows of that score or above; and totals p and n.

    Rows are summed within ranges of scores, and the totals of the ranges above are added."""
    sliced = by_ranges(scores, by, score)
    totals = sliced.groupBy(*by, "_slice").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = Window.partitionBy(*by).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    totals = totals.withColumns({"_ap": F.coalesce(F.sum("_p").over(above), F.lit(0)), "_an": F.coalesce(F.sum("_n").over(above), F.lit(0)), "p": F.sum("_p").over(whole), "n": F.sum("_n").over(whole)})
    inside = Window.partitionBy(*by, "_slice").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = sliced.withColumns({"_ip": F.sum("pos").over(inside), "_in": F.sum("neg").over(inside)})
    out = own.join(totals.drop("_p", "_n"), [*by, "_slice"])
    return out.select(*by, score, "pos", "neg", (F.col("_ap") + F.col("_ip")).alias("cum_pos"), (F.col("_an") + F.col("_in")).alias("cum_neg"), "p", "n")


def areas(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, auc, ap): area under the ROC curve with ties shared, null with one class only; average
    precision at the ends of tie groups, null without positives or negatives."""
    below = F.col("n") - F.col("cum_neg")
    wins = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2.0))
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    sums = curve.groupBy(*by).agg(wins.alias("w"), F.sum(F.col("pos") * precision).alias("s"), F.max("p").alias("p"), F.max("n").alias("n"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return sums.select(*by, F.when(both, rounded(F.try_divide(F.col("w"), F.col("p").cast("double") * F.col("n")))).alias("auc"), F.when(both, rounded(F.try_divide(F.col("s"), F.col("p").cast("double")))).alias("ap"))


def one_vs_rest(df: DataFrame, code: str = "code", proba: str = "proba") -> DataFrame:
    """(class_code, auc, ap) of each class against the others."""
    cells = known(df, code).select(F.col(code).alias("_y"), F.posexplode(F.col(proba)).alias("class_code", "score")).withColumn("hit", F.col("_y") == F.col("class_code"))
    return areas(cumulated(score_table(cells, ["class_code"], "score", "hit"), ["class_code"], "score"), ["class_code"])


def macro_areas(classes: DataFrame) -> DataFrame:
    """Means over the classes for which the area is defined."""
    return classes.agg(rounded(F.avg("auc")).alias("macro_auc"), rounded(F.avg("ap")).alias("macro_ap"))


def binary_rows(df: DataFrame, benign_code: int, code: str = "code", proba: str = "proba") -> DataFrame:
    """Rows as attack or not: hit, score (1 - P(benign)) and said (by largest probability)."""
    return known(df, code).select((F.col(code) != benign_code).alias("hit"), (1 - F.element_at(F.col(proba), benign_code + 1)).alias("score"), (predicted(proba) != benign_code).alias("said"))


def binary(df: DataFrame, benign_code: int, code: str = "code", proba: str = "proba") -> DataFrame:
    """One row of the attack-or-benign view: counts, rates, areas."""
    rows = binary_rows(df, benign_code, code, proba)
    counts = rows.agg(F.count_if(F.col("hit") & F.col("said")).alias("tp"), F.count_if(~F.col("hit") & F.col("said")).alias("fp"), F.count_if(F.col("hit") & ~F.col("said")).alias("fn"), F.count_if(~F.col("hit") & ~F.col("said")).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    area = areas(cumulated(score_table(rows, [], "score", "hit"), [], "score"), [])
    return counts.crossJoin(area).select(
        "tp", "fp", "fn", "tn", rounded(ratio(tp + tn, tp + fp + fn + tn)).alias("accuracy"), rounded(ratio(tp, tp + fp)).alias("precision"), rounded(ratio(tp, tp + fn)).alias("recall"),
        rounded(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"), rounded(ratio(fp, fp + tn)).alias("false_alarm"), rounded(ratio(fn, tp + fn)).alias("miss"), "auc", "ap",
    )


def sweep(curve: DataFrame, by: Sequence[str] = (), score: str = "score", most: int | None = 512) -> DataFrame:
    """(by, threshold, tpr, fpr, precision, f1) at distinct scores, thinned to `most` with both ends.

    A threshold takes scores equal to it. Thinning keeps every n-th point in order.
    """
    tpr, fpr = ratio(F.col("cum_pos"), F.col("p")), ratio(F.col("cum_neg"), F.col("n"))
    precision, f1 = ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")), ratio(2 * F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg") + F.col("p"))
    out = curve.select(*by, F.col(score).alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"), precision.alias("precision"), f1.alias("f1"), (F.col("cum_pos") + F.col("cum_neg")).alias("_at"))
    if most is None:
        return out.drop("_at")
    # The place of a point among its curve's points, again without ordering a curve in one task.
    sliced = by_ranges(out, by, "threshold")
    n = sliced.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    n = n.withColumns({"_before": F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(*by))})
    placed = sliced.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(F.desc("threshold")))).join(n.drop("_n"), [*by, "_slice"])
    at = F.col("_before") + F.col("_in") - 1
    step = lambda i: F.floor(i * (most - 1) / F.greatest(F.col("_all") - 1, F.lit(1)))
    kept = (F.col("_all") <= most) | (at == 0) | (at == F.col("_all") - 1) | (step(at) != step(at - 1))
    return placed.where(kept).select(*by, "threshold", "tpr", "fpr", "precision", "f1")


def recommended(points: DataFrame, budget: float = 0.01) -> DataFrame:
    """(rule, threshold, tpr, fpr, precision, f1): best F1, best tpr - fpr, best tpr with fpr in the
    budget; of ties the highest threshold."""
    rules = [("best_f1", F.col("f1"), F.lit(True)), ("youden", F.col("tpr") - F.col("fpr"), F.lit(True)), ("fpr_budget", F.col("tpr"), F.col("fpr") <= budget)]
    columns = ["threshold", "tpr", "fpr", "precision", "f1"]
    row = points.agg(*(F.max_by(F.struct(*columns), F.when(ok, F.struct(F.round(gain, 12), F.col("threshold")))).alias(rule) for rule, gain, ok in rules))
    out = row.select(F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("x")) for rule, _, _ in rules))).alias("y"))
    return out.select("y.rule", *(rounded(F.col(f"y.x.{c}")).alias(c) for c in columns))


def operating_point(points: DataFrame, threshold: float) -> DataFrame:
    """The point of the highest threshold not above the given one; else that of the lowest threshold."""
    columns = ["threshold", "tpr", "fpr", "precision", "f1"]
    at = F.max_by(F.struct(*columns), F.when(F.col("threshold") <= threshold, F.col("threshold")))
    row = points.agg(F.coalesce(at, F.min_by(F.struct(*columns), "threshold")).alias("x"))
    return row.select(*(rounded(F.col(f"x.{c}")).alias(c) for c in columns))


def worst(classes: DataFrame, n: int = 3) -> DataFrame:
    return classes.where("support > 0").orderBy("recall", "support", "code").limit(n)


def compare(table: DataFrame, by: str, key: Sequence[str], rising: bool = False) -> DataFrame:
    """Models by a metric, undefined last, with rank; a row a model. A table with a column `split` also
    gets mixed_split: whether its rows come from several splits and can't be compared."""
    if "split" in table.columns:
        every = Window.partitionBy()
        table = table.withColumn("mixed_split", F.min("split").over(every) != F.max("split").over(every))
    value = F.when(~F.isnan(by), F.col(by))
    order = value.asc_nulls_last() if rising else value.desc_nulls_last()
    return table.withColumn("rank", F.rank().over(Window.orderBy(order))).orderBy("rank", *key)


def leaderboard(validation: DataFrame, test: DataFrame, metric: str, primary: str | None = None) -> DataFrame:
    """Models by the validation metric, the winner (or `primary`) with its one test score.

    validation: (model, metric); test: (model, test_<metric>) of the winner.
    """
    out = validation.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(metric), "model")))
    winner = F.col("model") == primary if primary else F.col("rank") == 1
    return out.withColumn("winner", winner).join(test, "model", "left").withColumn(f"test_{metric}", F.when(F.col("winner"), F.col(f"test_{metric}")))


def evaluate(df: DataFrame, codec: DataFrame, benign_code: int, curves: bool = True, code: str = "code", proba: str = "proba") -> dict[str, DataFrame]:
    """The whole report as tables; those that are not used do not run.

    Probabilities are checked first (see score.checked_proba: a negative or non-finite one, or a row
    without all classes, raises an error when it is read) and stored, for every table reads them.
    """
    n = codec.count()
    complete = F.when(F.size(proba) == n, F.col(proba)).otherwise(F.raise_error(F.lit(f"a row needs {n} probabilities")).cast("array<double>"))
    df = stored(df.select(F.col(code).alias("code"), checked_proba(complete).alias("proba")), "evaluated")
    cm = confusion(df, codec)
    classes = per_class(cm)
    out = {
        "confusion": cm, "classes": classes, "averages": averages(classes), "confused": most_confused(cm), "absent": absent(classes), "top_k": top_k_accuracy(df),
        "log_loss": log_loss(df), "agreement": agreement(cm), "calibration": calibration(df), "unknown": unknown_count(df),
    }
    if curves:
        curve = cumulated(score_table(binary_rows(df, benign_code), [], "score", "hit"), [], "score")
        points = sweep(curve)
        out |= {"areas": one_vs_rest(df), "binary": binary(df, benign_code), "sweep": points, "recommended": recommended(points)}
    return out


def summary(report: dict[str, DataFrame]) -> DataFrame:
    """(metric, value) of a report with curves, a row for each single number."""

    def tall(df: DataFrame) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns))
        return df.select(F.explode(pairs).alias("x")).select("x.*")

    one = [report["averages"], report["log_loss"], report["agreement"], calibration_error(report["calibration"]), report["unknown"], macro_areas(report["areas"])]
    out = report["top_k"].select(F.concat(F.lit("top_"), F.col("k").cast("string")).alias("metric"), F.col("accuracy").alias("value"))
    for df in one:
        out = out.unionByName(tall(df))
    return out
