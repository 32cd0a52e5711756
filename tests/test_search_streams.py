"""Concurrent search with cancelled trials; late rows and chained states of streams."""

import time

import pytest
from pyspark.sql import functions as F

from flowlens import streaming
from flowlens.operators import models, tune
from flowlens.plans import catalog
from flowlens.sources import dims
from tests.test_queries import rows, tables  # noqa: F401


@pytest.fixture(scope="module")
def table(spark):
    noisy = F.pmod(F.xxhash64("id"), F.lit(10)) < 2
    code = F.when(noisy, 1 - F.col("id") % 2).otherwise(F.col("id") % 2).cast("int")
    df = spark.range(240).select("id", code.alias("code"), (F.col("id") % 2 + F.rand(1) / 2).alias("x"), F.rand(2).alias("y"))
    return df.withColumn("c", F.when(F.col("code") == 0, "n").otherwise("a")).persist()


class Fixed:
    """Says class 1 with a certainty that the parameters give, and runs `slow` seconds in a task."""

    def __init__(self, p, slow):
        self.p, self.slow = p, slow

    def transform(self, df):
        slow = self.slow

        def run(batches):
            time.sleep(slow)
            yield from batches

        certain = F.when(F.col("x") >= 1, self.p).otherwise(1 - self.p)
        return df.withColumn("proba", F.array(1 - certain, certain)).coalesce(1).mapInArrow(run, "id long, code int, x double, y double, c string, fold int, proba array<double>")


def searched(spark, table, workers, slow=lambda p: 0.0, timeout=600.0, trials=9):
    fit = lambda _, p: Fixed(p.get("p", 0.6), slow(p))
    space = {"p": [0.2, 0.35, 0.5, 0.6, 0.7, 0.8, 0.9], "n": [1, 2, 3]}
    return tune.search(table, "c", ["id"], dims.class_table(spark, ["n", "a"]), fit, space, metric="log_loss", trials=trials, k=3, warm=3, workers=workers, timeout=timeout)


def test_any_number_of_workers_finds_the_same(spark, table):
    one, many = searched(spark, table, 1), searched(spark, table, 4)
    assert one[0] == many[0] and one[0]["p"] in (0.7, 0.8)
    a, b = (sorted(map(tuple, t.drop("value", "spread").collect()), key=lambda r: r[0]) for _, t in (one, many))
    assert [(r[0], r[1], r[2], len(r[3])) for r in a] == [(r[0], r[1], r[2], len(r[3])) for r in b]
    assert {"done", "pruned"} == {r[2] for r in a}


def test_trials_out_of_time_are_cancelled(spark, table):
    began = time.monotonic()
    best, out = searched(spark, table, 3, slow=lambda p: 60.0 if p.get("n") == 3 else 0.0, timeout=12.0, trials=8)
    status = {r["trial"]: (r["status"], r["params"]) for r in out.collect()}
    assert time.monotonic() - began < 50
    assert status[-1][0] == "done" and any(s == "timeout" for s, _ in status.values())
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_a_tree_is_searched_at_once(spark, table):
    fit = lambda d, p: models.fit("tree", d, ["x", "y"], "code", 2, **p)
    best, out = tune.search(table, "c", ["id"], dims.class_table(spark, ["n", "a"]), fit, {"maxDepth": [1, 99]}, trials=4, k=2, workers=3)
    got = {r["params"]: r["status"].split(":")[0] for r in out.collect()}
    assert got["{}"] == "done" and all(s == ("failed" if "99" in p else "done") for p, s in got.items() if p != "{}")


def test_late_rows_of_chained_states(spark, tmp_path):
    source, folder, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    put = lambda data: spark.createDataFrame(data, "id long, kind string, at string").select("id", "kind", F.col("at").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(source)
    put([(1, "a", "2024-01-01 10:05:00"), (1, "a", "2024-01-01 10:05:00"), (2, "a", "2024-01-01 10:40:00"), (3, "b", "2024-01-01 11:10:00"), (4, "b", "2024-01-01 12:30:00")])
    schema = spark.read.parquet(source).schema

    def run(df):
        out = streaming.distinct_windows(df, ["id"], "kind")
        return streaming.run_available(out, folder=folder, checkpoint=f"{folder}-checkpoint", progress=progress)

    first = run(streaming.read_stream(spark, source, schema, 1))
    assert {(str(r["start"])[11:13], r["class"], r["n"]) for r in first.collect()} == {("10", "a", 2), ("11", "b", 1)}
    # Late: behind 12:20, the watermark. A copy of row 4 is dropped as such, not as late.
    put([(5, "a", "2024-01-01 10:59:00"), (6, "b", "2024-01-01 12:19:00"), (4, "b", "2024-01-01 12:30:00"), (7, "b", "2024-01-01 12:45:00"), (8, "a", "2024-01-01 13:05:00")])
    run(streaming.read_stream(spark, source, schema, 1))
    put([(9, "z", "2024-01-02 00:00:00")])
    last = run(streaming.read_stream(spark, source, schema, 1))
    got = {(str(r["start"])[11:13], r["class"], r["n"]) for r in last.collect()}
    assert got == {("10", "a", 2), ("11", "b", 1), ("12", "b", 2), ("13", "a", 1)}
    late = {r["operator"]: r["late"] for r in streaming.late_rows(spark, progress).collect()}
    assert sum(late.values()) == 2 and len(late) == 2 and max(late, key=late.get).startswith("dedupe")
    assert spark.read.parquet(progress).select("run").distinct().count() == 3


def test_chained_states_as_sql_has_them(spark, small, tables):  # noqa: F811
    got = catalog.QUERIES["stream_distinct_windows"](spark, small).toPandas()
    assert len(got) and rows(got) == rows(tables.execute(catalog.ORACLES["stream_distinct_windows"]).df())
