"""Preprocessing fitted on training rows: clip, impute, scale. Fits are aggregations of one row; what
they found goes into later plans as literals."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import ranks
from flowlens.functions.local import local_table
from flowlens.operators.clean import finite
from flowlens.operators.impute import knn_impute  # noqa: F401

SCALERS = ("standard", "minmax", "robust", "none")


@dataclass(frozen=True)
class Fitted:
    """What fit() learned of one feature."""

    feature: str
    raw_median: float = 0.0
    constant: bool = False
    lower: float | None = None
    upper: float | None = None
    median: float = 0.0
    centre: float = 0.0
    spread: float = 1.0


@dataclass(frozen=True)
class Stats:
    rows: list[Fitted] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        """Features in use: those that are not constant."""
        return [r.feature for r in self.rows if not r.constant]

    def subset(self, features: Sequence[str]) -> Stats:
        """The fit on selected features: each column's statistics are its own, so nothing is refitted."""
        return Stats([r for r in self.rows if r.feature in set(features)])

    def table(self, df: DataFrame) -> DataFrame:
        schema = "feature string, raw_median double, constant boolean, lower double, upper double, median double, centre double, spread double"
        return local_table(df.sparkSession, [(r.feature, r.raw_median, r.constant, r.lower, r.upper, r.median, r.centre, r.spread) for r in self.rows], schema)


def quantiles(df: DataFrame, wanted: dict[str, list[float]], accuracy: int | None = None, counts: dict[str, int] | None = None) -> dict[tuple[str, float], float | None]:
    """Interpolated quantiles, exact in five scans; with an accuracy, Spark's approximate ones in one."""
    if accuracy is None:
        return ranks.quantiles(df, wanted, counts)
    measures = {(c, q): F.percentile_approx(c, q, accuracy) for c, qs in wanted.items() for q in qs}
    return _row(df, measures) if measures else {}


def clip(c: Column, lower: float | None, upper: float | None) -> Column:
    """c within the bounds; null stays null."""
    out = c
    if lower is not None and math.isfinite(lower):
        out = F.when(out < lower, F.lit(lower)).otherwise(out)
    if upper is not None and math.isfinite(upper):
        out = F.when(out > upper, F.lit(upper)).otherwise(out)
    return out


def _row(df: DataFrame, measures: dict[tuple[str, str], Column]) -> dict[tuple[str, str], float]:
    got = df.agg(*(c.alias(f"_{i}") for i, c in enumerate(measures.values()))).first()
    return dict(zip(measures, got, strict=True))


def _unfilled(rank: int, n: int, missing: int, middle: int) -> int | None:
    """The rank among n values of what has this rank once `missing` copies of their median are put in
    behind rank `middle`, the lower of the median's two; none for a copy."""
    return rank if rank <= middle else None if rank <= middle + missing else rank - missing


def fit(df: DataFrame, features: Sequence[str], q: float = 0.999, scaler: str = "standard", drop_constant: bool = True, accuracy: int | None = None) -> Stats:
    """Statistics of every feature. One aggregation counts and finds constants, quantiles() the medians
    and bounds, and one aggregation the moments once imputed. Clipping keeps the order and imputing puts
    copies of the median in the middle, so the median once clipped and the robust scaler's quantiles come
    from the same order statistics, in the same five scans."""
    if scaler not in SCALERS:
        raise ValueError(f"scaler is one of {SCALERS}")
    if not 0.5 < q < 1.0:
        raise ValueError("the clip quantile lies between 0.5 and 1")
    raw = df.select(*(finite(F.col(c).cast("double")).alias(c) for c in features))
    first = {(k, c): x for c in features for k, x in (("n", F.count(c)), ("constant", F.min(c).eqNullSafe(F.max(c))))}
    got = _row(raw, first | {("rows", ""): F.count(F.lit(1))})
    n = {c: got["n", c] for c in features}
    sides = {c: ranks.places(n[c], 0.5) for c in features if n[c]}
    again = (0.25, 0.5, 0.75) if scaler == "robust" and accuracy is None else ()
    rows = got["rows", ""]
    if accuracy is None:
        wanted = {c: [1 - q, q] for c in features}
        ends = {(c, p): ranks.places(n[c], p) for c in sides for p in wanted[c]}
        filled_rank = {c: (lambda r, c=c: _unfilled(r, n[c], rows - n[c], sides[c][0])) for c in sides}
        later = {c: sorted({x for p in again for r in ranks.places(rows, p)[:2] if (x := filled_rank[c](r)) is not None}) for c in sides}
        value = ranks.order_statistics(raw, {c: [*sides[c][:2], *(r for p in wanted[c] for r in ends[c, p][:2]), *later[c]] for c in sides})
        found = {(c, p): ranks.between(value[c, e[0]], value[c, e[1]], e[2]) for (c, p), e in ends.items()}
        middle = {c: (value[c, sides[c][0]], value[c, sides[c][1]]) for c in sides}
    else:
        found = quantiles(raw, {c: [1 - q, q, 0.5] for c in sides}, accuracy)
        middle = {c: (found[c, 0.5], found[c, 0.5]) for c in sides}
    share = {c: e[2] for c, e in sides.items()}
    stats = []
    for c in features:
        low, high = found.get((c, 1 - q)), found.get((c, q))
        if low is not None and low > high:
            low = None
        stats.append(Fitted(c, ranks.between(*middle[c], share[c]) if c in middle else 0.0, bool(got["constant", c]) and drop_constant, low, high))
    used = [s for s in stats if not s.constant]
    if not used:
        raise ValueError("no feature is left: all are constant")
    held = lambda s, v: min(max(v, s.lower if s.lower is not None else v), s.upper if s.upper is not None else v)
    medians = {s.feature: ranks.between(*(held(s, v) for v in middle[s.feature]), share[s.feature]) if s.feature in middle else 0.0 for s in used}
    clipped = raw.select(*(clip(F.col(s.feature), s.lower, s.upper).alias(s.feature) for s in used))
    filled = clipped.select(*(F.coalesce(F.col(s.feature), F.lit(medians[s.feature])).alias(s.feature) for s in used))
    if scaler == "robust":
        if accuracy is None:
            at = lambda s, r: medians[s.feature] if s.feature not in sides or (x := filled_rank[s.feature](r)) is None else held(s, value[s.feature, x])
            cut = {(s.feature, p): ranks.between(at(s, e[0]), at(s, e[1]), e[2]) if rows else None for s in used for p in again for e in (ranks.places(rows, p),)}
        else:
            cut = quantiles(filled, {s.feature: [0.25, 0.5, 0.75] for s in used}, accuracy)
        moments = {(k, s.feature): v for s in used for k, v in (("centre", cut[s.feature, 0.5]), ("spread", cut[s.feature, 0.75] - cut[s.feature, 0.25]))}
    elif scaler == "none":
        moments = {}
    else:
        pair = (lambda c: (F.avg(c), F.stddev_pop(c))) if scaler == "standard" else (lambda c: (F.min(c), F.max(c) - F.min(c)))
        moments = _row(filled, {(k, s.feature): x for s in used for k, x in zip(("centre", "spread"), pair(s.feature), strict=True)})
    out = []
    for s in stats:
        if s.constant:
            out.append(s)
            continue
        spread = moments.get(("spread", s.feature), 1.0)
        spread = 1.0 if spread is None or not math.isfinite(spread) or spread < 1e-12 else spread
        out.append(replace(s, median=medians[s.feature], centre=moments.get(("centre", s.feature), 0.0) or 0.0, spread=spread))
    return Stats(out)


def align(df: DataFrame, stats: Stats, keep: Sequence[str] = ()) -> DataFrame:
    """keep and the fitted features, in order; an absent feature as its raw median."""
    have = set(df.columns)
    return df.select(*keep, *((F.col(r.feature).cast("double") if r.feature in have else F.lit(float(r.raw_median))).alias(r.feature) for r in stats.rows if not r.constant))


def transform(df: DataFrame, stats: Stats, keep: Sequence[str] = ()) -> DataFrame:
    """keep and the features: finite, clipped, imputed, scaled; narrow projections only."""
    used = [r for r in stats.rows if not r.constant]
    out = align(df, stats, keep)
    out = out.withColumns({r.feature: finite(F.col(r.feature)) for r in used})
    out = out.withColumns({r.feature: F.coalesce(clip(F.col(r.feature), r.lower, r.upper), F.lit(float(r.median))) for r in used})
    return out.withColumns({r.feature: (F.col(r.feature) - r.centre) / r.spread for r in used})


def inverse(df: DataFrame, stats: Stats) -> DataFrame:
    """Scaled features in their own units (within the clip bounds)."""
    return df.withColumns({r.feature: F.col(r.feature) * r.spread + r.centre for r in stats.rows if not r.constant and r.feature in df.columns})


def class_weights(df: DataFrame, label: str, scheme: str = "balanced", most: float = 50.0) -> DataFrame:
    """(class, n, weight): n_rows / (classes * n), its square root, or 1; `most` at most."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    balanced = F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))
    weight = {"balanced": balanced, "sqrt": F.sqrt(balanced), "none": F.lit(1.0)}[scheme]
    return counts.withColumn("weight", F.least(weight.cast("double"), F.lit(most)))


def with_weights(df: DataFrame, label: str, weights: DataFrame) -> DataFrame:
    """df with the weight of each row's class, 1 for classes without."""
    table = weights.select(F.col("class").alias("_class"), "weight")
    out = df.join(F.broadcast(table), df[label] == table["_class"], "left")
    return out.select(*(df[c] for c in df.columns), F.coalesce("weight", F.lit(1.0)).alias("weight"))
