"""Order statistics, correlations and curves that hold no column in one task."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions import ranks
from flowlens.operators import evaluate, prep, select


@pytest.fixture(scope="module")
def columns(spark):
    r = np.random.default_rng(1)
    n = 3_000
    data = {
        "normal": r.normal(0, 1, n), "same": np.full(n, 4.25), "few": r.integers(-2, 3, n).astype(float),
        "close": 1 + r.integers(0, 500, n) * 2.0**-52, "wide": np.exp(r.normal(0, 200, n)) * r.choice([-1, 1], n),
        "ends": np.where(np.arange(n) % 3 == 0, math.inf, -math.inf), "zero": np.where(np.arange(n) % 2 == 0, 0.0, -0.0),
    }
    rows = [tuple(None if k == "normal" and i % 7 == 0 else float(v[i]) for k, v in data.items()) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{k} double" for k in data)).repartition(5), data


def test_every_rank_is_exact(columns):
    df, data = columns
    want = {k: np.sort(v[np.arange(len(v)) % 7 != 0] if k == "normal" else v) for k, v in data.items()}
    asked = {k: [0, 1, 7, len(v) // 2, len(v) - 1] for k, v in want.items()}
    got = ranks.order_statistics(df, asked)
    assert all(got[k, r] == want[k][r] for k in want for r in asked[k])


def test_quantiles_are_those_of_percentile(columns):
    df, data = columns
    qs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    names = [k for k in data if k != "ends"]
    got = ranks.quantiles(df, dict.fromkeys(names, qs))
    row = df.agg(*(F.percentile(k, qs).alias(k) for k in names)).first()
    assert all(got[k, q] == pytest.approx(row[k][i], rel=1e-12) for k in names for i, q in enumerate(qs))


def test_ranks_in_turns_and_of_nothing(spark, columns, monkeypatch):
    df, data = columns
    monkeypatch.setattr(ranks, "MOST", 3)
    assert ranks.order_statistics(df, {"few": [0, 5, 9], "same": [1]}) == {("few", 0): -2.0, ("few", 5): -2.0, ("few", 9): -2.0, ("same", 1): 4.25}
    assert ranks.quantiles(df.limit(0), {"few": [0.5]}) == {("few", 0.5): None}
    with pytest.raises(ValueError):
        ranks.order_statistics(df, {"few": [3_000]})


@pytest.mark.parametrize("scaler", prep.SCALERS)
def test_fit_with_nulls_and_no_value(spark, scaler):
    rows = [(float(i % 50) if i % 4 else None, None, 1.0, float("nan") if i % 9 == 0 else float(i * i)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    stats = {s.feature: s for s in prep.fit(df, ["a", "b", "c", "d"], 0.9, scaler).rows}
    a = np.array([r[0] for r in rows if r[0] is not None])
    d = np.array([r[3] for r in rows if not math.isnan(r[3])])
    assert stats["c"].constant and stats["b"].raw_median == 0.0
    for x, s in ((a, stats["a"]), (d, stats["d"])):
        low, high = np.quantile(x, [0.1, 0.9])
        clipped = np.clip(x, low, high)
        filled = np.append(clipped, [np.median(clipped)] * (400 - len(x)))
        assert (s.lower, s.upper, s.raw_median, s.median) == pytest.approx((low, high, np.median(x), np.median(clipped)))
        centre = {"standard": filled.mean(), "minmax": filled.min(), "robust": np.median(filled), "none": 0.0}[scaler]
        spread = {"standard": filled.std(), "minmax": np.ptp(filled), "robust": np.subtract(*np.quantile(filled, [0.75, 0.25])), "none": 1.0}[scaler]
        assert (s.centre, s.spread) == pytest.approx((centre, spread))


def test_correlations_of_seventy_seven_columns(spark):
    r = np.random.default_rng(3)
    x = r.normal(0, 1, (500, 77)) @ r.normal(0, 1, (77, 77)) + 1e4
    x[:, 5] = 3.0
    names = [f"column {i}" for i in range(77)]
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], ", ".join(f"`{c}` double" for c in names))
    got = {(a["a"], a["b"]): a["r"] for a in select.correlations(df, names).collect()}
    with np.errstate(invalid="ignore"):
        want = np.nan_to_num(np.corrcoef(x.T))
    assert len(got) == 77 * 76 // 2
    assert all(got[names[i], names[j]] == pytest.approx(want[i, j], abs=1e-9) for i in range(77) for j in range(i + 1, 77))


def test_curves_of_scores_that_lie_close(spark):
    """200,000 scores within 1e-5 of 1: ranges by rank stay about even."""
    df = spark.range(200_000).select(F.lit("x").alias("c"), (1 - F.col("id") * 5e-11).alias("score"), (F.col("id") % 3 == 0).alias("hit"))
    table = evaluate.score_table(df, ["c"], "score", "hit")
    sizes = [r["count"] for r in evaluate.by_ranges(table, ["c"], "score").groupBy("_slice").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    curve = evaluate.cumulated(table, ["c"], "score")
    last = curve.orderBy("score").first()
    assert (last["cum_pos"], last["cum_neg"], last["p"], last["n"]) == (66_667, 133_333, 66_667, 133_333)
    third = curve.where(F.col("score") == 1 - 3 * 5e-11).first()
    assert (third["cum_pos"], third["cum_neg"]) == (2, 2)
    points = evaluate.sweep(curve, ["c"], most=100).collect()
    assert 90 <= len(points) <= 101
