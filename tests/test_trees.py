"""Trees grown level by level, and their attributions against sums over all subsets."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import models, trees
from flowlens.plans import catalog
from tests.test_queries import rows, tables  # noqa: F401


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (900, 4))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] * x[:, 2] > 0.2)
    data = [(i, *map(float, v), int(c), bool(i % 4 == 0)) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id int, a double, b double, c double, d double, code int, held boolean").repartition(3)


NAMES = ["a", "b", "c", "d"]


def expectation(tree, node, row, known, out):
    i = tree.feature[node]
    if i < 0:
        return np.array(tree.value[node])
    left = tree.left[node]
    if i in known:
        return expectation(tree, left if row[i] <= tree.cut[node] else left + 1, row, known, out)
    return sum(tree.cover[left + s] / tree.cover[node] * expectation(tree, left + s, row, known, out) for s in (0, 1))


def by_subsets(model, row, target):
    d, phi = len(row), np.zeros(len(row))
    for tree in model.trees:
        if tree.target not in (-1, target):
            continue
        for j in range(d):
            others = [i for i in range(d) if i != j]
            for n in range(d):
                for s in itertools.combinations(others, n):
                    gain = expectation(tree, 0, row, {*s, j}, None) - expectation(tree, 0, row, set(s), None)
                    phi[j] += math.factorial(n) * math.factorial(d - n - 1) / math.factorial(d) * gain[target if tree.target < 0 else 0]
    return phi / (len(model.trees) if model.kind == "mean" else 1)


@pytest.mark.parametrize("kind", ["extra", "boosted", "spark"])
def test_attributions_are_the_sum_over_subsets(table, kind):
    if kind == "extra":
        model = trees.extra_trees(table, NAMES, "code", 3, trees=4, depth=4)
    elif kind == "boosted":
        model = trees.softmax_boosting(table, NAMES, "code", 3, rounds=2, depth=3)
    else:
        fitted = models.fit("forest", table, NAMES, "code", 3, numTrees=3, maxDepth=4)
        model = trees.of_spark(fitted.stages.stages[-1], NAMES)
        own = {r["id"]: r["proba"] for r in model.transform(table).collect()}
        assert all(r["proba"] == pytest.approx(own[r["id"]], abs=1e-9) for r in fitted.transform(table).collect())
    x = np.random.default_rng(2).normal(0, 1, (12, 4))
    for target in range(3):
        got, expected = trees.attributions(model, x, target)
        assert np.allclose(got, [by_subsets(model, row, target) for row in x], atol=1e-12)
        assert np.allclose(got.sum(axis=1) + expected, model.scores(x)[:, target], atol=1e-9)
    out = trees.tree_contributions(table, model, ["id"], 1)
    assert out.columns == ["id", *NAMES, "expected", "score"] and out.count() == 900
    assert out.where(F.abs(F.col("a") + F.col("b") + F.col("c") + F.col("d") + F.col("expected") - F.col("score")) > 1e-6).count() == 0


def test_trees_learn_and_do_not_depend_on_partitions(table):
    for fit in (lambda t: trees.extra_trees(t, NAMES, "code", 3, trees=12, depth=8, tries=3), lambda t: trees.softmax_boosting(t, NAMES, "code", 3, rounds=6, depth=3)):
        model, again = fit(table), fit(table.repartition(7, "id"))
        assert [t.feature for t in model.trees] == [t.feature for t in again.trees]
        assert all(np.allclose(a.cut, b.cut) and np.allclose(a.cover, b.cover) for a, b in zip(model.trees, again.trees, strict=True))
        got = model.transform(table).select("code", "proba").collect()
        assert np.mean([int(np.argmax(r["proba"])) == r["code"] for r in got]) > 0.85
        assert all(sum(r["proba"]) == pytest.approx(1) for r in got)
        for t in model.trees:
            assert t.cover[0] == 900
            for at, left in enumerate(t.left):
                if t.feature[at] >= 0:
                    assert t.cover[at] == pytest.approx(t.cover[left] + t.cover[left + 1])


def test_early_stopping_keeps_the_best_rounds(table):
    noise = table.withColumn("code", F.pmod(F.xxhash64("id"), F.lit(3)).cast("int"))
    model = trees.softmax_boosting(noise, NAMES, "code", 3, held="held", rounds=8, depth=2, rate=0.9, patience=2)
    assert len(model.trees) < 24
    kept = trees.softmax_boosting(table, NAMES, "code", 3, held="held", rounds=4, depth=3)
    loss = lambda m: m.transform(table.where("held")).agg(F.avg(-F.ln(F.element_at("proba", F.col("code") + 1)))).first()[0]
    first = trees.Ensemble(NAMES, 3, "softmax", kept.trees[:3], kept.present)
    assert loss(kept) < loss(first) < math.log(3)


def test_shared_probabilities_beat_a_model_for_each_class(spark, table):
    """Held-out log loss against binary models, one a class and normalised, of as many rounds."""
    train, rest = table.where("not held"), table.where("held")
    joint = trees.softmax_boosting(train, NAMES, "code", 3, rounds=3, depth=3)
    x = np.array([[r[c] for c in NAMES] for r in rest.orderBy("id").collect()])
    y = np.array([r["code"] for r in rest.orderBy("id").collect()])
    apart = np.stack([trees.softmax_boosting(train.withColumn("code", (F.col("code") == c).cast("int")), NAMES, "code", 2, rounds=3, depth=3).probabilities(x)[:, 1] for c in range(3)], axis=1)
    apart /= apart.sum(axis=1, keepdims=True)
    loss = lambda p: -np.log(p[np.arange(len(y)), y]).mean()
    assert loss(joint.probabilities(x)) < 1.02 * loss(apart)


def test_nulls_weights_and_absent_classes(spark):
    data = [(i, None if i % 9 == 0 else float(i % 10), 2.0, i % 2 * 2 if i % 11 else None, float(1 + i % 3)) for i in range(300)]
    df = spark.createDataFrame(data, "id int, x double, same double, code int, w double")
    for model in (trees.extra_trees(df, ["x", "same"], "code", 4, "w", trees=3, depth=3), trees.softmax_boosting(df, ["x", "same"], "code", 4, "w", rounds=2, depth=2)):
        p = [r["proba"] for r in model.transform(df).collect()]
        assert len(p) == 300 and all(len(v) == 4 and v[1] == v[3] == 0.0 and sum(v) == pytest.approx(1) for v in p)
        assert model.trees[0].cover[0] == sum(w for *_, c, w in data if c is not None)
        assert all(f != 1 for t in model.trees for f in t.feature)
        again = trees.Ensemble.of_dict(json.loads(json.dumps(model.as_dict())))
        assert [r["proba"] for r in again.transform(df).collect()] == p


@pytest.mark.parametrize("name", ["extra_tree", "boosted_round"])
def test_trees_as_sql_has_them(spark, small, tables, name):  # noqa: F811
    got = catalog.QUERIES[name](spark, small).toPandas()
    want = tables.execute(catalog.ORACLES[name]).df()
    assert len(got) >= 2 and rows(got) == rows(want)


def test_boosting_reads_sums_of_bins(spark):
    """Rows of equal bins and class are one row of the table that the levels read, with the sum of their weights."""
    rows = spark.createDataFrame([(float(i % 50), i % 2, 2.0) for i in range(1000)] + [(None, 0, 1.0), (float("nan"), 0, 1.0)], "x0 double, y int, w double")
    got = sorted(map(tuple, trees._binned(rows, [[9.0, 24.0]]).collect()))
    assert got == [(0, 0, 200.0), (0, 1, 200.0), (1, 0, 320.0), (1, 1, 280.0), (2, 0, 482.0), (2, 1, 520.0)]


def test_levels_read_rows_kept_as_blocks(spark, table, monkeypatch):
    """Extra trees read their rows once: levels read blocks of bytes, which are let go in the end."""
    seen, cuts = [], trees._gini_cuts
    monkeypatch.setattr(trees, "_gini_cuts", lambda rows, *rest: seen.append((rows.columns, rows.storageLevel.useMemory)) or cuts(rows, *rest))
    model = trees.extra_trees(table.withColumn("w", F.lit(2.0)), NAMES, "code", 3, "w", trees=2, depth=3)
    assert seen == [(["x", "y", "w"], True)] * 3 and all(t.cover[0] == 1800 for t in model.trees)
    nan = np.array([[np.nan] * 4, [0.5, -0.5, 0.1, 2.0]])
    for t in model.trees:
        want = []
        for row in nan:
            at = 0
            while t.feature[at] >= 0:
                at = t.left[at] + (not row[t.feature[at]] <= t.cut[at])
            want.append(at)
        assert t.leaves(nan).tolist() == want
