"""Samples, splits and folds by hash order; see functions.portable."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.local import local_table
from flowlens.functions.portable import class_rank, hash01, hash_int, ratio, rounded, slice_counts


def class_counts(df: DataFrame, label: str) -> dict[str, int]:
    """Rows of each class, on the driver: a label has few values."""
    return {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}


def sizes_of(slices: DataFrame) -> dict[str, int]:
    """Rows of each class, from slice_counts()."""
    return {r[0]: r[1] for r in slices.where(F.col("_class").isNotNull()).groupBy("_class").agg(F.sum("_n")).collect()}


def quota_table(df: DataFrame, quotas: dict[str, int], label: str) -> DataFrame:
    return local_table(df.sparkSession, list(quotas.items()) or [("", 0)], f"`{label}` string, quota long")


def sampling_plan(df: DataFrame, label: str, caps: dict[str, int]) -> DataFrame:
    """(class, available, cap, kept, strategy, share) with uncapped classes kept whole."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("available"))
    table = quota_table(df, caps, "class").withColumnRenamed("quota", "cap")
    plan = counts.join(F.broadcast(table), "class", "left").withColumn("kept", F.least("available", F.coalesce("cap", "available")))
    strategy = F.when(F.col("kept") < F.col("available"), "capped").otherwise("all")
    total = F.sum("kept").over(Window.partitionBy())
    return plan.select("class", "available", "cap", "kept", strategy.alias("strategy"), rounded(ratio(F.col("kept"), total)).alias("share"))


def sampling_report(df: DataFrame, label: str, caps: dict[str, int], least: int = 3) -> DataFrame:
    """(class, problem, kept): capped classes without a row, and classes that keep too few to stratify."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    table = quota_table(df, caps, "class").withColumnRenamed("quota", "cap").where("class != ''")
    both = counts.join(table, "class", "full").withColumn("kept", F.least(F.coalesce("n", F.lit(0)), F.coalesce("cap", "n")))
    problem = F.when(F.col("n").isNull(), "absent").when(F.col("kept") < least, "too few to stratify")
    return both.select("class", problem.alias("problem"), "kept").where("problem is not null")


def capped(df: DataFrame, label: str, key: Sequence[str], caps: dict[str, int], seed: str) -> DataFrame:
    """df with at most caps[class] rows of a class, the first in hash order.

    Rows that cannot be among the first are dropped before the shuffle: by the count of a class, a
    hash above twice its cap's share cannot be (but for classes under 1,000 rows, which stay whole).
    """
    counts = class_counts(df, label)
    limit = {c: min(1.0, 2.0 * cap / counts[c] + 1000.0 / counts[c]) for c, cap in caps.items() if c in counts}
    if not limit:
        return df
    near = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in limit.items() for x in p)), F.col(label)), F.lit(1.0))
    part = df.where(F.col(label).isin(*limit)).where(hash01(seed, key) < near)
    quota = F.element_at(F.create_map(*(F.lit(x) for p in caps.items() for x in p)), F.col(label))
    top = class_rank(part, label, key, seed, "_rank").where(F.col("_rank") <= quota).drop("_rank")
    return df.where(~F.col(label).isin(*limit) | F.col(label).isNull()).unionByName(top)


def bernoulli(df: DataFrame, label: str, key: Sequence[str], rates: dict[str, float], seed: str) -> DataFrame:
    """Rows whose hash falls under the rate of their class (1 if none is given): no shuffle, replay-stable."""
    if not rates:
        return df
    rate = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in rates.items() for x in p)), F.col(label)), F.lit(1.0))
    return df.where(hash01(seed, key) < rate)


def streamed_rates(counts: dict[str, int], caps: dict[str, int], over: float = 1.06) -> dict[str, float]:
    """Keep rates of a first pass that leave a little over the caps."""
    return {c: min(1.0, over * cap / counts[c]) for c, cap in caps.items() if counts.get(c)}


def two_pass(df: DataFrame, label: str, key: Sequence[str], caps: dict[str, int], seed: str, over: float = 1.06) -> DataFrame:
    """Count, keep by rate, trim to the caps. A class may end below its cap, as the rate leaves it."""
    kept = bernoulli(df, label, key, streamed_rates(class_counts(df, label), caps, over), f"{seed}-rate")
    return capped(kept, label, key, caps, seed)


def budget_plan(counts: dict[str, int], budget: int, floor: int) -> dict[str, int]:
    """Rows a class: a floor each, then by headroom, the rest to the largest classes; the budget in all."""
    classes = sorted(counts, key=lambda c: (-counts[c], c))
    if sum(counts.values()) <= budget:
        return dict(counts)
    plan = {c: min(counts[c], floor, budget // max(1, len(classes))) for c in classes}
    room = {c: counts[c] - plan[c] for c in classes}
    left, total = budget - sum(plan.values()), sum(room.values())
    if total and left > 0:
        for c in classes:
            plan[c] += left * room[c] // total
    for c in classes:
        more = min(budget - sum(plan.values()), counts[c] - plan[c])
        plan[c] += max(0, more)
    return plan


def budgeted(df: DataFrame, label: str, key: Sequence[str], budget: int, floor: int, seed: str) -> DataFrame:
    """A stratified subsample of at most `budget` rows."""
    return capped(df, label, key, budget_plan(class_counts(df, label), budget, floor), seed)


def half_even(x: float) -> int:
    return round(x)


def split_sizes(n: int, test: float, val: float) -> tuple[int, int, int]:
    """(train, val, test) of a class of n rows."""
    if n <= 3:
        return {0: (0, 0, 0), 1: (1, 0, 0), 2: (1, 0, 1), 3: (1, 1, 1)}[n]
    t, v = max(1, half_even(n * test)), max(1, half_even(n * val))
    while n - t - v < n // 2 and (t > 1 or v > 1):
        if t >= v and t > 1:
            t -= 1
        else:
            v -= 1
    return n - t - v, v, t


def split(df: DataFrame, label: str, key: Sequence[str], test: float, val: float, seed: str) -> DataFrame:
    """df with `split`: test, val or train, stratified by class in hash order."""
    slices = slice_counts(df, label, key, seed)
    sizes = {c: split_sizes(n, test, val) for c, n in sizes_of(slices).items()}
    ends = [(c, s[2], s[2] + s[1]) for c, s in sizes.items()]
    table = local_table(df.sparkSession, ends or [("", 0, 0)], "_class string, _test long, _val long")
    ranked = class_rank(df.where(F.col(label).isNotNull()), label, key, seed, "_rank", slices)
    out = ranked.join(F.broadcast(table), ranked[label] == table["_class"])
    part = F.when(F.col("_rank") <= F.col("_test"), "test").when(F.col("_rank") <= F.col("_val"), "val").otherwise("train")
    return out.withColumn("split", part).select(*df.columns, "split")


def split_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows by class and split, with the total."""
    out = df.groupBy(F.col(label).alias("class")).pivot("split", ["train", "val", "test"]).count().na.fill(0)
    return out.withColumn("total", F.col("train") + F.col("val") + F.col("test"))


def leaks(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Row contents (features and label) that stand in more than one split."""
    return df.groupBy(*features, label).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def folds(df: DataFrame, label: str, key: Sequence[str], k: int, seed: str) -> DataFrame:
    """df with `fold` 0..k-1: ranks dealt in turn, from an offset by class."""
    if k < 2:
        raise ValueError("at least two folds")
    ranked = class_rank(df.where(F.col(label).isNotNull()), label, key, seed, "_rank")
    fold = F.pmod(F.col("_rank") - 1 + hash_int("fold", [label]) % k, F.lit(k)).cast("int")
    return ranked.withColumn("fold", fold).select(*df.columns, "fold")


def holdout(df: DataFrame, label: str, key: Sequence[str], fraction: float, seed: str) -> DataFrame:
    """df with `held`: at least one row of a class of two or more, never the last one left."""
    slices = slice_counts(df, label, key, seed)
    n = sizes_of(slices)
    quota = {c: 0 if m < 2 else min(m - 1, max(1, half_even(m * fraction))) for c, m in n.items()}
    table = quota_table(df, quota, "_class")
    ranked = class_rank(df.where(F.col(label).isNotNull()), label, key, seed, "_rank", slices)
    out = ranked.join(F.broadcast(table), ranked[label] == table["_class"])
    return out.withColumn("held", F.col("_rank") <= F.col("quota")).select(*df.columns, "held")


def bootstrap_times(df: DataFrame, key: Sequence[str], seed: str, replicates: int = 1) -> DataFrame:
    """df by replicate with _times, how often a row is drawn: a Poisson(1) number by hash; rows never drawn are left out.

    A hash is compared with the steps as hex digits, which order as the numbers do."""
    steps, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        steps.append(f"{math.ceil(total * (1 << 32)):08x}")  # eight digits: below 2**32
    names = F.when(F.coalesce(*(F.col(c).cast("string") for c in key)).isNotNull(), F.concat_ws("|", *(F.col(c).cast("string") for c in key)))
    hashed = df.withColumn("_name", names).select(*df.columns, *(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(str(r)), "_name")), 1, 8).alias(f"_h{r}") for r in range(replicates)))
    times = lambda r: sum((F.when(F.col(f"_h{r}") >= s, 1).otherwise(0) for s in steps), F.lit(0))
    each = F.inline(F.array(*(F.struct(F.lit(r).alias("replicate"), times(r).alias("_times")) for r in range(replicates))))
    return hashed.select(*df.columns, each).where("_times > 0")


def bootstrap(df: DataFrame, key: Sequence[str], seed: str, replicates: int = 1) -> DataFrame:
    """df with rows repeated as in samples with replacement: a Poisson(1) number of times by hash, in
    each replicate."""
    return bootstrap_times(df, key, seed, replicates).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")


def representatives(df: DataFrame, label: str, key: Sequence[str], proba: str = "proba", code: str = "code") -> DataFrame:
    """One row of each class: predicted rightly first, then by probability of the class, then by key."""
    own = F.element_at(F.col(proba), F.col(code) + 1)
    right = (F.array_position(F.col(proba), F.array_max(F.col(proba))) - 1 == F.col(code)).cast("int")
    best = F.struct((-right).alias("r"), (-own).alias("p"), *key)
    rest = [c for c in df.columns if c != label]
    out = df.groupBy(label).agg(F.min_by(F.struct(*rest), best).alias("_row"))
    return out.select(*(F.col(label) if c == label else F.col(f"_row.{c}").alias(c) for c in df.columns))
