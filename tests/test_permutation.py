"""Permutation by a bijection on row numbers."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowlens.operators import explain


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 255, 1000])
def test_partner_is_a_bijection(spark, n):
    at = spark.range(n).repartition(3).select("id", *(explain.partner(F.col("id"), n, "s", F.lit(r)).alias(f"p{r}") for r in (1, 2))).orderBy("id").toPandas()
    assert sorted(at["p1"]) == sorted(at["p2"]) == list(range(n))
    if n > 200:
        assert (at["p1"] == at["id"]).sum() < 10 and (at["p1"] == at["p2"]).sum() < 10


def test_only_one_feature_moves(spark):
    """Repeated keys and nulls; every variant keeps the values of each feature, and all but its own in place."""
    df = spark.createDataFrame([(i % 40, i % 3, float(i), None if i % 7 == 0 else i * 0.5) for i in range(50)], "k int, code int, a double, b double")
    rows, variants = explain.permuted(df, ["a", "b"], ["k"], "code", 2, "s")
    assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, df.collect()))
    whole = df.collect()
    for repeat in (1, 2):
        for moved in ("a", "b"):
            got = variants.where((F.col("repeat") == repeat) & (F.col("feature") == moved)).collect()
            kept = "b" if moved == "a" else "a"
            assert Counter(r[moved] for r in got) == Counter(r[moved] for r in whole)
            assert Counter((r["code"], r[kept]) for r in got) == Counter((r["code"], r[kept]) for r in whole)
            assert Counter((r["code"], r["a"], r["b"]) for r in got) != Counter((r["code"], r["a"], r["b"]) for r in whole)


def test_importance_of_the_feature_that_decides(spark):
    df = spark.range(3000).select("id", (F.col("id") % 2).cast("int").alias("code"), (F.col("id") % 2).cast("double").alias("x"), F.rand(1).alias("y"))
    score = lambda d: d.withColumn("proba", F.array(1 - F.col("x"), F.col("x")))
    got = {r["feature"]: r["raw_drop"] for r in explain.permutation_importance(df, ["x", "y"], ["id"], "code", score, 2).collect()}
    assert got["y"] == 0 and 0.4 < got["x"] < 0.6
    drop = {(r["feature"], r["code"]): r["drop"] for r in explain.recall_drop(df, ["x", "y"], ["id"], "code", score).collect()}
    assert drop["y", 0] == 0 and 0.4 < drop["x", 1] < 0.6
    assert explain.permutation_importance(df.limit(0), ["x"], ["id"], "code", score).count() == 0
