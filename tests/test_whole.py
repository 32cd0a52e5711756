"""Queries over every row, which SQL repeats."""

import pytest
from pyspark.sql import functions as F

from flowlens.plans import beds, catalog
from tests.test_queries import rows, tables  # noqa: F401


@pytest.mark.parametrize("name", ["occlusion", "occlusion_of_class", "top_contributions", "global_importance", "signature_features"])
def test_explains_every_row(spark, small, tables, name):  # noqa: F811
    got = catalog.QUERIES[name](spark, small).toPandas()
    want = tables.execute(catalog.ORACLES[name]).df()
    if name in ("occlusion", "occlusion_of_class", "top_contributions"):
        assert len(got) == beds.li(spark, small).count()
    assert rows(got) == rows(want)


def test_every_row_has_a_sentence(spark, small):
    out = catalog.QUERIES["sentences"](spark, small)
    n = beds.li(spark, small).count()
    r = out.agg(F.count("*").alias("n"), *(F.sum(F.col("sentence").contains(x).cast("int")).alias(k) for k, x in (("why", "resting on"), ("high", "(above normal)"), ("low", "(below normal)"), ("next", "Next: ")))).first()
    assert r["n"] == r["why"] == r["next"] == n and r["high"] > 0 and r["low"] > 0


@pytest.mark.parametrize("name", ["class_neighbours", "smote", "tomek_links", "resample_counts"])
def test_balances_every_row(spark, small, tables, name):  # noqa: F811
    got = catalog.QUERIES[name](spark, small).toPandas()
    assert rows(got) == rows(tables.execute(catalog.ORACLES[name]).df())
    if name == "class_neighbours":
        assert set(got["vec_id"]) == {r[0] for r in beds.table(spark, small, "embeddings").select("vec_id").collect()}
    if name == "smote":
        assert len(got) > 0 and 0 not in set(got["label"])


def test_names_with_all_are_the_same_queries():
    both = [n for n in catalog.QUERIES if f"{n}_all" in catalog.QUERIES]
    assert len(both) == 9
    for n in both:
        assert catalog.QUERIES[n] is catalog.QUERIES[f"{n}_all"] and catalog.ORACLES.get(n) == catalog.ORACLES.get(f"{n}_all")
