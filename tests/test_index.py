"""Nearest neighbours through the metric index against all pairs."""

import numpy as np
import pytest

from flowlens.operators import balance

SCHEMA = "id string, c int, v array<double>"


def all_pairs(rows, k):
    out = {}
    for i, c, v in rows:
        if c is None:
            continue
        d = sorted((round(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), 6), j) for j, e, w in rows if e == c and j != i)
        out[i] = [(j, x) for x, j in d[:k]]
    return out


def found(df):
    got = {}
    for r in df.orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["neighbour"], r["distance"]))
    return got


def clusters(seed, n, spread):
    r = np.random.default_rng(seed)
    middle = r.normal(0, 50, (12, 6))
    rows = []
    for i in range(n):
        v = middle[i % 12] + r.normal(0, spread, 6)
        rows.append((f"k{i:04d}", i % 2, [float(x) for x in v]))
    return rows


@pytest.mark.parametrize(("spread", "k"), [(1.0, 5), (60.0, 3), (0.0, 4)])
def test_same_as_all_pairs(spark, spread, k):
    """Clear clusters, none, and copies: ties go by key across parts."""
    rows = clusters(1, 400, spread) + [("null", None, [0.0] * 6), ("lone", 9, [1.0] * 6), ("two", 8, [1.0] * 6), ("twin", 8, [1.0] * 6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    work = {}
    got = found(balance.neighbours(df, "id", "c", "v", k, block=16, part_rows=20, work=work))
    want = {i: x for i, x in all_pairs(rows, k).items() if x}
    assert got.keys() == want.keys()
    assert all([(j, pytest.approx(d, abs=2e-6)) for j, d in want[i]] == got[i] for i in want)
    assert work["pairs"] > 10 * 400 or work["pairs"] >= 400
    if spread == 1.0:
        assert work["opened"] < 0.35 * work["pairs"]


def test_parts_that_hold_fewer_than_k_rows(spark):
    rows = [(f"a{i}", 0, [float(i), 0.0]) for i in range(7)] + [(f"b{i}", 0, [1000.0 + i, 0.0]) for i in range(3)]
    got = found(balance.neighbours(spark.createDataFrame(rows, SCHEMA), "id", "c", "v", 5, part_rows=2))
    want = all_pairs(rows, 5)
    assert got == want


def test_links_of_parts(spark):
    rows = clusters(3, 120, 2.0)
    df = spark.createDataFrame(rows, SCHEMA)
    one, many = (sorted(map(tuple, balance.tomek_links(df, "id", "c", "v", part_rows=n).collect())) for n in (10_000, 10))
    near = {i: x[0][0] for i, x in all_pairs([(i, 0, v) for i, _, v in rows], 1).items()}
    kind = {i: c for i, c, _ in rows}
    assert one == many == sorted((i, j) for i, j in near.items() if near[j] == i and kind[i] != kind[j])
    assert balance.neighbours(df.limit(0), "id", "c", "v").count() == 0


def test_a_row_is_sent_to_few_zones():
    """Whatever the number of parts, they fill some ZONES zones, of ZONE blocks of rows at most each slice."""
    part = lambda p, n: {"_own": "c", "_part": p, "_rows": n}
    zones = balance._zones([part(p, 2000 + p) for p in range(256)], 8192)
    assert len(zones) == 256 and len({z for z, _ in zones.values()}) <= balance.ZONES + 2 and {n for _, n in zones.values()} == {1}
    one = balance._zones([part(0, 100), part(1, 1_000_000)], 8192)
    assert one["c", 0][0] != one["c", 1][0] and one["c", 1][1] == -(-1_000_000 // (balance.ZONE * 8192))
