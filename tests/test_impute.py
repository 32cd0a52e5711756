"""The box index of the imputer against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions.portable import key_hash
from flowlens.operators import impute, prep

NAMES = ["a", "b", "c"]
SCHEMA = "k int, a double, b double, c double"


def all_pairs(rows, k):
    """rows: (key, hash, features); the filled features of each row."""
    out = []
    for key, _, x in rows:
        filled = list(x)
        own = [f for f, v in enumerate(x) if v is not None]
        for f in set(range(len(x))) - set(own):
            near = []
            for _, h, y in rows:
                both = [g for g in own if y[g] is not None]
                if both and y[f] is not None:
                    near.append((sum((y[g] - x[g]) * (y[g] - x[g]) for g in both) * len(x) / len(both), h, y[f]))
            near.sort()
            filled[f] = sum(v for _, _, v in near[:k]) / len(near[:k]) if near else None
        out.append((key, *filled))
    return sorted(out, key=str)


def compared(spark, points, k, parts):
    df = spark.createDataFrame(points, SCHEMA).repartition(3)
    hashes = {r["k"]: int(r["h"][:15], 16) for r in df.select("k", key_hash("knn", ["k"]).alias("h")).collect()}
    want = all_pairs([(p[0], hashes[p[0]], p[1:]) for p in points], k)
    got = sorted((tuple(r) for r in prep.knn_impute(df, NAMES, ["k"], k, parts=parts).collect()), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w)


def holed(seed, n, spread, share):
    r = np.random.default_rng(seed)
    middle = r.normal(0, 100, (8, 3))
    x = middle[np.arange(n) % 8] + r.normal(0, spread, (n, 3))
    gone = r.random((n, 3)) < share
    return [(i, *(None if g else round(float(v), 2) for v, g in zip(x[i], gone[i], strict=True))) for i in range(n)]


@pytest.mark.parametrize(("spread", "share"), [(2.0, 0.05), (80.0, 0.5), (0.0, 0.2)])
def test_same_as_all_pairs(spark, monkeypatch, spread, share):
    """Clusters, none with half of the cells missing, and copies; blocks of few rows and of few queries."""
    monkeypatch.setattr(impute, "ROWS", 40)
    monkeypatch.setattr(impute, "QUERIES", 16)
    compared(spark, holed(7, 320, spread, share), 3, 16)


def test_copies_ties_and_rare_sets(spark):
    """A third of the rows equal, repeated keys, features that never meet, rows without a value."""
    points = [(i % 5, 1.0, 2.0, 3.0) for i in range(60)] + [(100 + i, float(i), None, None) for i in range(20)] + [(200 + i, None, float(i), None) for i in range(4)]
    compared(spark, [*points, (300, None, None, None), (300, None, None, None), (301, 1.0, 2.0, None), (301, 1.0, 2.0, None)], 5, 8)


def test_far_parts_are_not_compared(spark):
    rows = spark.createDataFrame(holed(3, 6000, 1.0, 0.02), SCHEMA)
    data, asked, names = impute.incomplete(rows, NAMES, ["k"], "knn")
    best, opened = impute.nearest_cells(data, asked, names, 5)
    pairs = opened.agg(F.sum(F.col("_rows") * F.col("_asked"))).first()[0]
    assert best.count() >= 5 * asked.count()
    assert pairs < 0.3 * data.count() * asked.count()


def test_empty_complete_and_clashing(spark):
    """No rows, nothing missing, and columns named like internal ones; NaN and infinite cells are missing."""
    assert prep.knn_impute(spark.createDataFrame([], SCHEMA), NAMES, ["k"]).count() == 0
    whole = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], SCHEMA)
    assert [tuple(r) for r in prep.knn_impute(whole, NAMES, ["k"]).collect()] == [(1, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame([(1, 1.0, float("nan"), "x", 7), (2, 1.0, 4.0, "y", 8), (3, float("inf"), 9.0, "z", 9)], "k int, f0 double, _q double, _m0 string, _part int")
    got = sorted(tuple(r) for r in prep.knn_impute(df, ["f0", "_q"], ["k"], 1).collect())
    assert got == [(1, 1.0, 4.0, "x", 7), (2, 1.0, 4.0, "y", 8), (3, 1.0, 9.0, "z", 9)]


def test_equal_cells_beside_their_rounded_mean():
    """The mean of three cells of 0.1 isn't 0.1; such a leaf can't be cut."""
    rows = np.array([[0.1, np.nan], [0.1, np.nan], [0.1, np.nan]])
    assert (impute._spread(rows) == 0).all()
    tree = impute.Tree.fit(rows, np.array([[0.1, np.nan]]), 4)
    assert tree.feature == [-1]
