"""Feature ranking and selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.local import local_table
from flowlens.functions.portable import ratio
from flowlens.operators.prep import quantiles
from flowlens.operators.sample import bootstrap_times, budgeted


def unpivot(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, feature, value): a row per cell."""
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features))
    return df.select(*keep, F.explode(pairs).alias("_x")).select(*keep, "_x.*")


def anova(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = (), times: str | None = None, about: Sequence[float] = ()) -> DataFrame:
    """(by, feature, score): F of between-class to within-class variance; 0 where undefined. times: a column of
    how often a row counts; then squares are summed about these values, so that they don't cancel. Each row is aggregated once, all its features together; groups become rows after that."""
    x = {f"{i}": F.col(f"`{c}`").cast("double") for i, c in enumerate(features)}
    if times is None:
        sums = [f(v).alias(f"{n}{i}") for i, v in x.items() for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]
        cells = {i: (F.col(f"n{i}"), F.col(f"m{i}"), F.col(f"v{i}")) for i in x}
    else:
        w, about = F.col(times), dict(zip(x, about or [0.0] * len(x), strict=True))
        sums = [s.alias(f"{n}{i}") for i, v in x.items() for d in (v - F.lit(float(about[i])),) for n, s in (("n", F.sum(F.when(v.isNotNull(), w))), ("s", F.sum(w * d)), ("q", F.sum(w * d * d)))]
        m = {i: F.col(f"s{i}") / F.col(f"n{i}") for i in x}
        cells = {i: (F.col(f"n{i}"), m[i] + F.lit(float(about[i])), F.col(f"q{i}") / F.col(f"n{i}") - m[i] * m[i]) for i in x}
    cell = F.array(*(F.struct(F.lit(c).alias("feature"), n.alias("n"), m.alias("m"), v.alias("v")) for c, (n, m, v) in zip(features, cells.values(), strict=True)))
    groups = df.groupBy(*by, label).agg(*sums).select(*by, label, F.explode(cell).alias("_x")).select(*by, label, "_x.*").where("n > 0")
    mean = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy(*by, "feature")) / F.sum("n").over(Window.partitionBy(*by, "feature"))
    sums = groups.withColumn("g", mean).groupBy(*by, "feature").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.count("*").alias("k"), F.sum("n").alias("n")
    )
    score = ratio(ratio(F.col("between"), F.col("k") - 1), ratio(F.col("within"), F.col("n") - F.col("k")))
    return sums.select(*by, "feature", F.when(F.col("k") < 2, 0.0).otherwise(score).alias("score"))


def chi2(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, score): chi-square of min-max-scaled sums by class against class shares."""
    row = df.agg(*(f(c).alias(f"{n}_{i}") for i, c in enumerate(features) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    scaled = {}
    for i, c in enumerate(features):
        lo, hi = row[f"lo_{i}"], row[f"hi_{i}"]
        span = (hi - lo) if lo is not None and hi > lo else 1.0
        scaled[c] = F.greatest((F.col(c) - F.lit(lo or 0.0)) / F.lit(float(span)), F.lit(0.0))
    cells = unpivot(df.where(F.col(label).isNotNull()).select(label, *(x.alias(c) for c, x in scaled.items())), features, [label])
    groups = cells.groupBy("feature", label).agg(F.sum("value").alias("observed"), F.count("*").alias("n"))
    whole = Window.partitionBy("feature")
    groups = groups.withColumn("expected", F.sum("observed").over(whole) * F.col("n") / F.sum("n").over(whole))
    term = ratio((F.col("observed") - F.col("expected")) ** 2, F.col("expected"))
    return groups.groupBy("feature").agg(F.sum(term).alias("score"))


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 32, accuracy: int | None = None) -> DataFrame:
    """(feature, score): mutual information (nats) of equal-frequency bins and class, within [0, H(class)]."""
    cuts = [i / bins for i in range(bins + 1)]
    found = quantiles(df, {c: cuts for c in features}, accuracy)
    binned = {}
    for c in features:
        edges = sorted({found[c, q] for q in cuts} - {None})
        inner = edges[1:-1]
        binned[c] = F.when(F.col(c).isNotNull(), sum((F.when(F.col(c) >= e, 1).otherwise(0) for e in inner), F.lit(0))) if len(edges) >= 3 else F.lit(0)
    cells = unpivot(df.where(F.col(label).isNotNull()).select(label, *(x.cast("double").alias(c) for c, x in binned.items())), features, [label])
    cells = cells.where("value is not null").groupBy("feature", "value", label).agg(F.count("*").alias("n"))
    whole, of_bin, of_class = Window.partitionBy("feature"), Window.partitionBy("feature", "value"), Window.partitionBy("feature", label)
    cells = cells.withColumns({"t": F.sum("n").over(whole), "b": F.sum("n").over(of_bin), "c": F.sum("n").over(of_class)})
    part = F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("b") * F.col("c")))
    entropy = -F.col("n") / F.col("t") * F.ln(F.col("c") / F.col("t"))  # over all cells of a class this sums to H(class)
    out = cells.groupBy("feature").agg(F.sum(part).alias("mi"), F.sum(entropy).alias("h"))
    return out.select("feature", F.greatest(F.least("mi", "h"), F.lit(0.0)).alias("score"))


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(a, b, r) of every pair of features, 0 where undefined; a null takes no part in a sum.

    Each task adds up the products of its centred columns as one matrix, batch by batch; the sums of
    tasks, a row a pair, are added in Spark. The plan stays the same size for any number of features.
    """
    means = df.agg(*(F.coalesce(F.avg(f"`{c}`"), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(features))).first()
    centred = df.select(*((F.col(f"`{c}`").cast("double") - F.lit(float(means[i]))).alias(f"x{i}") for i, c in enumerate(features)))
    d = len(features)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            total += x.T @ x
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "p"])

    sums = centred.mapInArrow(products, "i long, j long, p double").groupBy("i", "j").agg(F.sum("p").alias("p"))
    own = sums.where("i = j").select("i", F.col("p").alias("s"))
    pairs = sums.where("i < j").join(own, "i").join(own.select(F.col("i").alias("j"), F.col("s").alias("t")), "j")
    names = F.array(*(F.lit(c) for c in features))
    at = lambda c: F.element_at(names, (F.col(c) + 1).cast("int"))
    return pairs.select(at("i").alias("a"), at("j").alias("b"), ratio(F.col("p"), F.sqrt(F.col("s") * F.col("t"))).alias("r"))


def prune(correlated: dict[tuple[str, str], float], features: Sequence[str], priority: dict[str, float], threshold: float = 0.95) -> tuple[list[str], dict[str, str]]:
    """Features kept in their order, and why others went: visited by falling priority, one goes if it
    correlates with one that stays."""
    r = lambda a, b: abs(correlated.get((a, b), correlated.get((b, a), 0.0)))
    kept: list[str] = []
    why: dict[str, str] = {}
    for c in sorted(features, key=lambda c: (-priority.get(c, 0.0), features.index(c))):
        other = next((k for k in kept if r(c, k) >= threshold), None)
        if other is None:
            kept.append(c)
        else:
            why[c] = f"correlates with {other} ({r(c, other):.3f})"
    return [c for c in features if c in set(kept)], why


def rfe(df: DataFrame, features: Sequence[str], label_code: str, n: int, step: float = 0.1, seed: int = 7, trees: int = 60, depth: int = 14) -> DataFrame:
    """(feature, rank): refits a forest and drops the weakest tenth, down to n features of rank 1."""
    left, rank = list(features), {}
    turn = 1
    while True:
        data = VectorAssembler(inputCols=left, outputCol="_v").transform(df)
        forest = RandomForestClassifier(featuresCol="_v", labelCol=label_code, numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed).fit(data)
        weight = dict(zip(left, forest.featureImportances.toArray().tolist(), strict=True))
        if len(left) <= n:
            break
        drop = min(len(left) - n, max(1, int(len(left) * step)))
        for c in sorted(left, key=lambda c: (weight[c], c))[:drop]:
            rank[c] = -turn
            left.remove(c)
        turn += 1
    rows = [(c, 1) for c in left] + [(c, turn + r + 1) for c, r in rank.items()]
    return local_table(df.sparkSession, rows, "feature string, rank int")


RANKERS = {"anova": anova, "chi2": chi2, "mutual_info": mutual_information}


def fuse(scores: DataFrame, first: str = "anova") -> DataFrame:
    """(feature, score, position) of (method, feature, score): mean reciprocal rank over the methods;
    ties by the first method's score, then name. A row a feature."""
    ranked = scores.withColumn("rank", F.rank().over(Window.partitionBy("method").orderBy(F.desc("score"))))
    own = F.max(F.when(F.col("method") == first, F.col("score"))).alias("tie")
    out = ranked.groupBy("feature").agg(F.avg(1 / F.col("rank")).alias("score"), own)
    place = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("tie"), "feature"))
    return out.select("feature", "score", place.alias("position"))


def rank_features(df: DataFrame, features: Sequence[str], label: str, methods: Sequence[str] = ("anova", "chi2", "mutual_info")) -> DataFrame:
    scores = None
    for m in methods:
        part = RANKERS[m](df, features, label).select(F.lit(m).alias("method"), "feature", F.round("score", 9).alias("score"))
        scores = part if scores is None else scores.unionByName(part)
    return fuse(scores, methods[0])


def select_features(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], n: int, threshold: float = 0.95, budget: int | None = None) -> DataFrame:
    """The n first of the fused ranking among the features that correlation pruning leaves."""
    rows = df if budget is None else budgeted(df, label, key, budget, 50, "select")
    priority = {r["feature"]: r["score"] for r in anova(rows, features, label).collect()}
    correlated = {(r["a"], r["b"]): r["r"] for r in correlations(rows, features).collect()}
    kept, _ = prune(correlated, list(features), priority, threshold)
    return rank_features(rows, kept, label).where(F.col("position") <= n)


def stability(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], n: int, replicates: int = 5, seed: str = "stab") -> DataFrame:
    """(feature, frequency, fragile): how often ANOVA puts a feature in the first n, over bootstraps
    that are scored together in one job; a row is weighed by its repeats, not repeated."""
    means = df.agg(*(F.coalesce(F.avg(F.col(f"`{c}`").cast("double")), F.lit(0.0)) for c in features)).first()
    scores = anova(bootstrap_times(df, key, seed, replicates), features, label, ["replicate"], "_times", list(means))
    place = F.row_number().over(Window.partitionBy("replicate").orderBy(F.desc("score"), "feature"))
    chosen = scores.withColumn("place", place).groupBy("feature").agg((F.count_if(F.col("place") <= n) / F.lit(float(replicates))).alias("frequency"))
    return chosen.withColumn("fragile", F.col("frequency") < 0.6)


def with_stability(ranking: DataFrame, stable: DataFrame) -> DataFrame:
    """The ranking with each feature's frequency, null where unknown."""
    return ranking.join(F.broadcast(stable), "feature", "left")


def top_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(k, shared, agreement) of the first k features of two rankings (feature, position)."""
    top = lambda x: x.where(F.col("position") <= k).select("feature")
    shared = top(a).join(top(b), "feature").agg(F.count("*").alias("shared"))
    return shared.select(F.lit(k).alias("k"), "shared", (F.col("shared") / F.lit(float(k))).alias("agreement"))


def agreement_at(a: DataFrame, b: DataFrame, ks: Sequence[int] = (5, 10, 15)) -> DataFrame:
    """(k, shared, agreement) of the first k features of two rankings, for each k."""
    both = a.select("feature", F.col("position").alias("_a")).join(b.select("feature", F.col("position").alias("_b")), "feature")
    sums = both.agg(*(F.count_if((F.col("_a") <= k) & (F.col("_b") <= k)).alias(f"k{k}") for k in ks))
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("shared"), (F.col(f"k{k}") / F.lit(float(k))).alias("agreement")) for k in ks))
    return sums.select(F.explode(rows).alias("x")).select("x.*")
