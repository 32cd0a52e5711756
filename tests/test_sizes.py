"""Plans and passes whose cost must not grow faster than the rows."""

import pytest
from pyspark.sql import functions as F

from flowlens.functions.portable import numbered
from flowlens.operators import explain, models, normalise


@pytest.fixture
def unsized(spark):
    """No join is broadcast because a table happens to be small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_are_not_sorted(unsized):
    """A class may hold most rows; a join by label would bring it to one task."""
    df = unsized.range(40).select(F.when(F.col("id") < 39, "heart_bleed").otherwise(" BENIGN ").alias("label"))
    out = normalise.normalise_labels(df, "label")
    assert "SortMergeJoin" not in plan(out)
    assert out.count() == 40


def test_partners_hash_each_coordinate_once(spark):
    """A row's walk looks its shifts up: sqrt(n) hashes a round, where each row had twelve or more of its own."""
    assert len(explain._shifts("s", 1, 0, 1000)) == 1000
    df = spark.range(5000).select("id", explain.partner(F.col("id"), 5000, "s", F.lit(1)).alias("p"))
    assert "md5" not in plan(df)
    assert df.select("p").distinct().count() == 5000


def test_numbering_takes_one_shuffle(spark):
    df = spark.range(100).select(F.pmod(F.col("id") * 37, F.lit(100)).alias("a"), F.lit("x").alias("b"))
    out = numbered(df, ["a"], "n", ["a"])
    assert "row_number" not in plan(out) and out.columns == ["a", "n"]
    assert out.where("a != n").count() == 0


@pytest.mark.parametrize("limit", [0, 128])
def test_centroids_in_columns_or_arrays(spark, monkeypatch, limit):
    """The same probabilities to the last bit; plain columns for few terms, without interpreted functions."""
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 3.0, 1.0), (2, 9.5, -4.0), (2, 0.1, 7.0), (None, 5.0, None)], "code int, a double, b double")
    model = models.fit_centroids(df, ["a", "b"], "code", 3)
    want = [r["proba"] for r in model._arrays(df).collect()]
    monkeypatch.setattr(models, "PLAIN", limit)
    out = model.transform(df)
    assert [r["proba"] for r in out.collect()] == want and out.columns == [*df.columns, "proba"]
    assert ("lambda" in plan(out)) == (limit == 0)


def test_reasons_without_a_shuffle(spark):
    """A record's contributions are found beside it, the same as in long form; ties go by name."""
    df = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("code"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), F.lit(1.0).alias("c"))
    model = models.fit_centroids(df, ["a", "b", "c"], "code", 2)
    asked = (df, ["a", "b", "c"], ["k"], model.transform, {"a": 3.0, "b": 1.0, "c": 1.0})
    top = explain.top_reasons(*asked, 2)
    wide = explain.wide_occlusion(*asked)
    assert "Exchange" not in plan(top) and "Exchange" not in plan(wide)
    long = {(r["k"], r["feature"]): (r["contribution"], r["value"]) for r in explain.occlusion(*asked).collect()}
    assert {(r["k"], f): r[f] for r in wide.collect() for f in "abc"} == {x: c for x, (c, _) in long.items()}
    for r in top.collect():
        want = sorted("abc", key=lambda f, k=r["k"]: (-round(abs(long[k, f][0]), 9), f))[:2]
        assert [(x["place"], x["feature"]) for x in r["reasons"]] == list(enumerate(want, 1))
        assert all((x["contribution"], x["value"]) == long[r["k"], x["feature"]] for x in r["reasons"])
    assert plan(wide).count("Coalesce") >= 4  # parts small enough to be compiled
