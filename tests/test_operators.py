"""Invariants and hand-written cases."""

import json
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from flowlens import streaming
from flowlens.functions.portable import class_rank, numbered
from flowlens.operators import balance, clean, evaluate, explain, models, narrate, normalise, prep, sample, score, select, tune
from flowlens.sources import dims, tables


def test_headers_and_labels(spark):
    assert [normalise.column_name(x) for x in (" Flow Duration", "Fwd  IAT   Total", "\xa0Idle Max\xa0")] == ["Flow Duration", "Fwd IAT Total", "Idle Max"]
    raw = ["Web Attack \u0096 Brute Force", "web attack - xss", " DoS  slowloris ", "botnet", "Heartbleed", "Made Up", "ftp-patator", " ", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, Label string")
    got = [r["Label"] for r in normalise.normalise_labels(df, "Label").orderBy("i").collect()]
    assert got == ["Web Attack - Brute Force", "Web Attack - XSS", "DoS slowloris", "Bot", "Rare Attacks", "Made Up", "FTP-Patator", None, None]


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ("Infinity", "inf", "NaN", " 1.5 ", "1,000", "abc", None)], "x string")
    r = normalise.coerced_counts(df, ["x"]).first()
    assert (r["coerced"], r["nonfinite"]) == (3, 2)
    assert [v["x"] for v in clean.nulls_for_nonfinite(normalise.numbers(df, ["x"]), ["x"]).where("x is not null").collect()] == [1.5]


def test_identifiers_and_repeated_headers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int").toDF("Flow ID", " x", "x ", "Unnamed: 0")
    named, collided = normalise.canonical_columns(df)
    assert collided == ["x"] and named.columns == ["Flow ID", "x", "Unnamed: 0"]
    kept, why = normalise.drop_identifiers(named)
    assert kept.columns == ["x"] and set(why) == {"Flow ID", "Unnamed: 0"}


def test_split_sizes():
    assert [sample.split_sizes(n, 0.2, 0.1) for n in (1, 2, 3, 4, 10, 25)] == [(1, 0, 0), (1, 0, 1), (1, 1, 1), (2, 1, 1), (7, 1, 2), (18, 2, 5)]


def test_budget_plan():
    plan = sample.budget_plan({f"c{i:02d}": 1000 for i in range(13)}, 100, 50)
    assert sum(plan.values()) == 100 and min(plan.values()) >= 7


def test_rank_is_a_permutation_whatever_the_partitions(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("c"))
    one = {(r["id"], r["rank"]) for r in class_rank(df.repartition(1), "c", ["id"], "s").collect()}
    assert one == {(r["id"], r["rank"]) for r in class_rank(df.repartition(7), "c", ["id"], "s").collect()}
    assert sorted(k for i, k in one if i % 10 == 0) == list(range(1, 501))


def test_caps_folds_and_holdout(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 100 == 0, "rare").otherwise("base").alias("c"))
    kept = sample.class_counts(sample.capped(df, "c", ["id"], {"base": 500, "absent": 3}, "s"), "c")
    assert kept == {"base": 500, "rare": 30}
    assert {r["count"] for r in sample.folds(df, "c", ["id"], 5, "s").where("c = 'rare'").groupBy("fold").count().collect()} == {6}
    held = sample.class_counts(sample.holdout(df, "c", ["id"], 0.1, "s").where("held"), "c")
    assert held == {"base": 297, "rare": 3}


def test_quantiles_constants_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (4.0, 5.0, None), (10.0, 5.0, 1.0), (float("nan"), 5.0, 3.0)], "x double, k double, n double")
    stats = prep.fit(df, ["x", "k", "n"], 0.99, "robust")
    by = {r.feature: r for r in stats.rows}
    assert by["x"].raw_median == 3.0 and by["k"].constant and stats.features == ["x", "n"]
    assert by["n"].raw_median == 2.0
    assert prep.transform(df, stats).where("x is null or n is null").count() == 0
    with pytest.raises(ValueError):
        prep.fit(df, ["k"], 0.99)


def test_refit_is_a_projection(spark):
    df = spark.range(200).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 29).cast("double").alias("b"))
    assert prep.fit(df, ["a", "b"], 0.99).subset(["b"]).rows == prep.fit(df, ["b"], 0.99).rows


def test_clip_keeps_nulls_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-5.0,)], "x double")
    assert [r["y"] for r in df.select(prep.clip(F.col("x"), -1.0, 1.0).alias("y")).collect()] == [None, 1.0, -1.0]


def test_contradictory_rows_stay(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 1.0, "b"), (3, 1.0, "a"), (4, None, "a")], "k int, x double, c string")
    assert {r["k"] for r in clean.clean(df, ["x"], "c", ["k"]).collect()} == {1, 2}
    assert clean.contradictions(df, ["x"], "c").count() == 1


def test_oversampling_plan():
    assert balance.targets({"base": 420000, "few": 105000, "rare": 47}, 0.25, 20)["rare"] == (940, True)
    assert balance.targets({"base": 420000, "few": 105000, "rare": 47}, 0.25, 20)["few"] == (105000, False)


def proba(spark, data):
    return spark.createDataFrame([Row(key=i, code=c, proba=p) for i, (c, p) in enumerate(data)], "key int, code int, proba array<double>")


def test_areas_on_edges(spark):
    tied = spark.createDataFrame([(True, 0.5), (False, 0.5), (True, 0.5)], "hit boolean, s double")
    cut = lambda d: evaluate.areas(evaluate.cumulated(evaluate.score_table(d, [], "s", "hit"), [], "s"), []).first()
    assert cut(tied)["auc"] == 0.5
    assert tuple(cut(tied.where("hit"))) == (None, None)


def test_calibration_edge_and_saturation(spark):
    rows = proba(spark, [(0, [0.3, 0.25, 0.25, 0.2])])
    assert evaluate.calibration(rows).first()["bin"] == 2
    df = spark.createDataFrame([(1.0,)], "p double")
    assert math.isclose(df.select(explain.log_odds(F.col("p")).alias("x")).first()["x"], 27.63, abs_tol=0.01)
    zero = proba(spark, [(0, [0.0, 0.0, 0.0, 0.0])])
    assert zero.select(score.checked_proba(F.col("proba")).alias("p")).first()["p"] == [0.25] * 4
    with pytest.raises(Exception, match="finite"):
        proba(spark, [(0, [-0.5, 1.5])]).select(score.checked_proba(F.col("proba"))).collect()


def test_threshold_is_apart_from_the_label(spark):
    rows = proba(spark, [(0, [0.4, 0.3, 0.2, 0.1]), (None, [0.9, 0.1, 0.0, 0.0])])
    got = score.verdicts(rows, ["n", "a", "b", "c"], "n").orderBy("key").collect()
    assert got[0]["pred"] == 0 and got[0]["is_attack"] and not got[1]["is_attack"]
    codec = dims.class_table(spark, ["n", "a", "b", "c"])
    table = score.verdict_table(score.verdicts(rows, ["n", "a", "b", "c"], "n"), codec, dims.profile_table(spark), ["key"], "n").orderBy("key").collect()
    assert [r["true_class"] for r in table] == ["n", None] and table[1]["correct"] is None
    assert evaluate.unknown_count(rows).first()["unknown"] == 1


def test_verdicts_do_not_depend_on_partitions(spark):
    rows = proba(spark, [(i % 3, [(i % 7) / 20, (i % 5) / 20, 0.1]) for i in range(300)]).withColumn("proba", score.checked_proba(F.col("proba")))
    one = sorted(map(tuple, score.verdicts(rows.repartition(1), ["x", "y", "z"], "x").drop("proba").collect()), key=str)
    assert one == sorted(map(tuple, score.verdicts(rows.repartition(9), ["x", "y", "z"], "x").drop("proba").collect()), key=str)


def test_planted_signal_ranks_first(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(1.0).alias("s") + F.rand(1), F.rand(2).alias("n"), F.lit(1.0).alias("k"))
    df = df.toDF("c", "s", "n", "k")
    assert select.rank_features(df, ["n", "s", "k"], "c").where("position = 1").first()["feature"] == "s"
    assert {r["r"] for r in select.correlations(df, ["s", "k"]).collect()} == {0.0}


def test_prune_keeps_the_stronger():
    kept, why = select.prune({("a", "b"): 0.99, ("b", "c"): 0.1, ("a", "c"): 0.2}, ["a", "b", "c"], {"a": 1.0, "b": 2.0, "c": 0.5})
    assert kept == ["b", "c"] and "b" in why["a"]


def test_phrases(spark):
    df = spark.createDataFrame([(p,) for p in (1.0, 0.95, 0.8, 0.5, 0.3, 0.1)], "p double")
    assert [r[0] for r in df.select(narrate.confidence_phrase(F.col("p"))).collect()] == ["almost certainly", "very likely", "likely", "probably", "possibly", "weakly suggestive of"]
    assert len(dims.PROFILES) == 13 and {c for p in dims.PROFILES for c in p[4]} <= set(dims.CLASSES) and len(dims.FEATURES) == 77


def test_csv_round_trip(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    head = " Flow Duration, Fwd Header Length, Fwd Header Length,Timestamp, Label"
    (folder / "Monday-WorkingHours.pcap_ISCX.csv").write_bytes(f"{head}\n1,2,9,t,BENIGN\nInfinity,x,9,t,Web Attack \x96 XSS\n3,4,9,t,\n".encode("latin-1"))
    (folder / ".hidden.csv").write_text(f"{head}\n7,7,7,t,BENIGN\n")
    out = tables.load_flows(spark, str(folder))
    assert out.columns == [*dims.FEATURES, "Label"]
    got = {(r["Label"], r["Flow Duration"], r["Fwd Header Length"]) for r in out.collect()}
    assert got == {("BENIGN", 1.0, 2.0), ("Web Attack - XSS", float("inf"), None)}
    assert tables.missing_files(spark, str(folder)).count() == 7
    with pytest.raises(FileNotFoundError):
        tables.discover(spark, str(tmp_path / "raw" / "none") if (tmp_path / "raw" / "none").mkdir() is None else "")


def test_split_cache(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3).toDF("x")
    for _ in range(2):
        assert tables.cached_split(spark, str(tmp_path), {"seed": 1}, make).count() == 3
    assert len(calls) == 1 and tables.settings_digest({"a": 1}) != tables.settings_digest({"a": 2})
    broken = lambda: spark.range(3).select(F.raise_error(F.lit("lost")).cast("int").alias("x"))
    with pytest.raises(Exception, match="lost"):
        tables.cached_split(spark, str(tmp_path), {"seed": 2}, broken)
    assert tables.cached_split(spark, str(tmp_path), {"seed": 2}, make).count() == 3


def test_results_are_written(spark, tmp_path):
    df = spark.range(3).toDF("x")
    tables.write_tables({"a": df, "b": df.limit(1)}, str(tmp_path))
    assert [spark.read.parquet(f"{tmp_path}/{n}").count() for n in "ab"] == [3, 1]
    for kind in ("csv", "parquet"):
        tables.write_verdicts(df, f"{tmp_path}/v", kind)
    assert spark.read.parquet(f"{tmp_path}/v").count() == 3


def test_refuses_a_table_without_features(spark):
    stats = prep.fit(spark.createDataFrame([(1.0,), (2.0,)], "x double"), ["x"], 0.99)
    with pytest.raises(ValueError):
        score.prepare(spark.createDataFrame([("t",)], "timestamp string"), stats, [])


def test_model_saves_and_loads(spark, tmp_path):
    df = spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("code"), (F.col("id") % 2 + F.rand(3)).alias("x"))
    model = models.fit("logistic", df, ["x"], "code", 3)
    told = models.save(model, str(tmp_path / "m"), df, ["id"], ["no", "yes", "lost"], {"accuracy": 1.0})
    assert told["features"] == ["x"] and models.manifest_of(spark, str(tmp_path / "m"))["metrics"] == {"accuracy": 1.0}
    again = models.load(spark, str(tmp_path / "m")).transform(df).orderBy("id").first()
    assert len(again["proba"]) == 3 and again["proba"][2] == 0.0
    boosted = models.fit("boosted", df, ["x"], "code", 2, maxIter=2, maxDepth=2).transform(df)
    assert boosted.select(F.avg((evaluate.predicted() == F.col("code")).cast("double"))).first()[0] > 0.9


def test_linear_contributions_add_up(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "k int, a double, b double")
    out = explain.linear_contributions(df, ["a", "b"], ["k"], [2.0, -1.0], {"a": 1.0, "b": 1.0})
    assert out.agg(F.sum("contribution")).first()[0] == (2 * 2.0 - 3.0) - (2 * 1.0 - 1.0)


def test_expanded_probabilities(spark):
    df = spark.createDataFrame([([0.25, 0.75],)], "p array<double>")
    assert df.select(models.expanded(F.col("p"), [0, 2], 4).alias("x")).first()["x"] == [0.25, 0.0, 0.75, 0.0]


def test_search_keeps_defaults_unless_beaten(spark):
    df = spark.range(120).select("id", (F.col("id") % 2).cast("int").alias("code"), F.when(F.col("id") % 2 == 0, "n").otherwise("a").alias("c"), (F.col("id") % 2).cast("double").alias("x"))
    fit = lambda rows, p: models.fit("tree", rows, ["x"], "code", 2, **p)
    best, trials = tune.search(df, "c", ["id"], dims.class_table(spark, ["n", "a"]), fit, {"maxDepth": [99]}, trials=1, k=2)
    got = {r["trial"]: r["status"] for r in trials.collect()}
    assert best == {} and got[-1] == "done" and got[0].startswith("failed")


def test_knn_imputer(spark):
    df = spark.createDataFrame([(i, float(i % 2) * 10, float(i % 2) * 100) for i in range(20)] + [(99, 10.0, None)], "k int, a double, b double")
    assert prep.knn_impute(df, ["a", "b"], ["k"], 3).where("k = 99").first()["b"] == 100.0


def test_micro_batches_add_up(spark, tmp_path):
    rows = proba(spark, [(i % 3, [(i % 7) / 20, (i % 5) / 20, 0.1]) for i in range(60)])
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.read_stream(spark, str(tmp_path / "in"), rows.schema, 1)
    streaming.evaluate_batches(stream, str(tmp_path / "state")).awaitTermination()
    got = {(r["code"], r["pred"]): r["n"] for r in streaming.confusion_so_far(spark, str(tmp_path / "state")).collect()}
    want = {(r["code"], r["pred"]): r["n"] for r in evaluate.confusion(rows, dims.class_table(spark, ["x", "y", "z"])).where("n > 0").collect()}
    assert got == want


def test_batch_equals_stream_for_windows(spark, tmp_path):
    df = spark.range(200).select((F.timestamp_seconds(F.col("id") * 600)).alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"))
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: streaming.event_time(streaming.closed(streaming.read_stream(spark, str(tmp_path / "in"), df.schema), "ts"), "ts", "10 minutes")
    want = sorted(map(tuple, streaming.windowed(df, "c").collect()))
    assert sorted(map(tuple, streaming.run_available(streaming.windowed(stream(), "c")).collect())) == want
    assert {tuple(r)[:4] for r in streaming.run_available(streaming.windowed(stream(), "c"), "update").collect() if r["c" if "c" in r else "class"]} == set(want)
    again = str(tmp_path / "out")  # a second run of a stream adds nothing
    for _ in range(2):
        got = streaming.run_available(streaming.tally(streaming.read_stream(spark, str(tmp_path / "in"), df.schema), "c"), "complete", again)
    assert sorted(map(tuple, got.collect())) == [("a", 67), ("b", 133)]


def test_sentence(spark):
    verdict = spark.createDataFrame([(1, "Bot", 0.95)], "k int, prediction string, confidence double")
    top = spark.createDataFrame([(1, "Flow Duration", 1, 3.0)], "k int, feature string, place int, value double")
    text = narrate.sentences(verdict, top, dims.gloss_table(spark), ["k"]).first()["sentence"]
    assert text == "This record is very likely Bot (95.0%), resting on the flow duration (far above normal)."


def test_neighbours_by_brute_force_over_blocks(spark):
    points = [(f"k{i:03d}", i % 2, [float(i * 7 % 23), float(i * i % 11), float(i % 3)]) for i in range(150)] + [(f"t{i}", 0, [1.0, 1.0, 1.0]) for i in range(20)]
    df = spark.createDataFrame(points, "k string, c int, v array<double>").repartition(3)
    far = lambda a, b: round(math.dist(a[2], b[2]), 6)
    near = lambda a, of, n: [(a[0], b[0], d, p) for p, (d, b) in enumerate(sorted((far(a, b), b) for b in of if b[0] != a[0])[:n], 1)]
    want = sorted(x for a in points for x in near(a, [b for b in points if b[1] == a[1]], 5))
    assert sorted(map(tuple, balance.neighbours(df, "k", "c", "v", 5, block=16).collect())) == want
    first = {a[0]: near(a, points, 1)[0][1] for a in points}
    label = {a[0]: a[1] for a in points}
    links = sorted((a, b) for a, b in first.items() if first[b] == a and label[a] != label[b])
    assert links and sorted(map(tuple, balance.tomek_links(df, "k", "c", "v", block=16).collect())) == links


def test_knn_imputer_searches_all_rows(spark):
    points = [(i, float(i * 37 % 6007), float(i * 91 % 499), float(i % 83)) for i in range(6000)]
    points += [(10_000 + n, float(n * 131 % 6007), None, float(n) if n % 2 else None) for n in range(40)] + [(20_000, None, None, None), (20_001, 5.0, None, 5.0), (20_001, 5.0, None, 5.0)]
    df = spark.createDataFrame(points, "k int, a double, b double, c double").repartition(3)

    def filled(p):
        own = [j for j in (1, 2, 3) if p[j] is not None]
        out = list(p)
        for j in {1, 2, 3} - set(own):
            near = []
            for r in points:
                both = [f for f in own if r[f] is not None]
                if both and r[j] is not None:
                    near.append((sum((r[f] - p[f]) ** 2 for f in both) * 3 / len(both), r[j]))
            near.sort()
            out[j] = [sum(v for _, v in near[:5]) / 5, near[4][0] < near[5][0]] if near else None
        return out

    got = [tuple(r) for r in prep.knn_impute(df, ["a", "b", "c"], ["k"]).where("k >= 10000").orderBy("k").collect()]
    want = sorted((filled(p) for p in points if p[0] >= 10_000), key=lambda p: p[0])
    assert len(got) == len(want)
    sure = 0
    for g, w in zip(got, want, strict=True):
        for x, y in zip(g, w, strict=True):
            if not isinstance(y, list):
                assert x == y
            elif y[1]:
                sure += 1
                assert x == pytest.approx(y[0])
    assert sure > 10


@pytest.mark.parametrize("kind", ["boosted", "tree", "centroids"])
def test_artifacts_of_every_kind(spark, tmp_path, kind):
    df = spark.range(200).select("id", (F.col("id") % 2 * 2).cast("int").alias("code"), (F.col("id") % 2 + F.rand(3)).alias("x"))
    model = models.fit_centroids(df, ["x"], "code", 3) if kind == "centroids" else models.fit(kind, df, ["x"], "code", 3, maxDepth=2, **({"maxIter": 2} if kind == "boosted" else {}))
    path = str(tmp_path / "m")
    for _ in range(2):  # a second artifact takes the first one's place
        told = models.save(model, path, df, ["id"])
    assert told["digest"] == models.manifest_of(spark, path)["digest"]
    a, b = (m.transform(df).orderBy("id").select("proba").collect() for m in (model, models.load(spark, path)))
    assert a == b and len(a[0]["proba"]) == 3
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["m"]
    spark.createDataFrame([(json.dumps({**told, "digest": "x"}),)], "value string").write.mode("overwrite").text(f"{path}/manifest")
    with pytest.raises(ValueError):
        models.load(spark, path)


@pytest.mark.parametrize("kind", ["bayes", "tree", "forest", "extra", "mlp"])
def test_models_learn(spark, kind):
    df = spark.range(240).select("id", (F.col("id") % 3).cast("int").alias("code"), (F.col("id") % 3 + F.rand(3) / 2).alias("x"), F.rand(5).alias("y"))
    params = {"bayes": {}, "tree": {"maxDepth": 4}, "forest": {"numTrees": 5, "maxDepth": 4}, "extra": {"numTrees": 5, "maxDepth": 4}, "mlp": {"hidden": [8], "maxIter": 200}}[kind]
    out = models.fit(kind, df, ["x", "y"], "code", 3, **params).transform(df)
    r = out.select(F.avg((evaluate.predicted() == F.col("code")).cast("double")).alias("a"), F.max(F.abs(F.aggregate("proba", F.lit(0.0), lambda s, p: s + p) - 1)).alias("gap")).first()
    assert r["a"] > 0.9 and r["gap"] < 1e-9


def test_rfe_and_stability_find_the_telling_feature(spark):
    df = spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("code"), F.when(F.col("id") % 2 == 0, "n").otherwise("a").alias("c"), (F.col("id") % 2 + F.rand(1) / 4).alias("good"), F.rand(2).alias("n1"), F.rand(3).alias("n2"))
    ranks = {r["feature"]: r["rank"] for r in select.rfe(df, ["n1", "good", "n2"], "code", 1, trees=5, depth=4).collect()}
    assert ranks["good"] == 1 and sorted(ranks.values()) == [1, 2, 3]
    stable = {r["feature"]: r for r in select.stability(df, ["n1", "good", "n2"], "c", ["id"], 1, 4).collect()}
    assert stable["good"]["frequency"] == 1.0 and not stable["good"]["fragile"] and all(r["fragile"] for f, r in stable.items() if f != "good")


def test_strategies(spark):
    points = [(i, i % 4 == 0, [float(i % 4 == 0) * 10 + i % 3, float(i % 5)]) for i in range(40)] + [(100, True, [0.0, 0.1]), (101, False, [10.0, 0.1])]
    df = spark.createDataFrame(points, "k int, c boolean, v array<double>").withColumn("c", F.col("c").cast("int"))
    n = lambda s: {(r["c"], r["synthetic"]): r["count"] for r in balance.resample(df, "k", "c", "v", s, {0: 31, 1: 20}).groupBy("c", "synthetic").count().collect()}
    whole = {(0, False): 31, (1, False): 11}
    assert n("none") == n("class_weight") == whole and n("oversample") == n("smote") == {**whole, (1, True): 9}
    assert balance.resample(df, "k", "c", "v", "smote", {1: 20}).select("k").distinct().count() == 51
    kept = {r["k"] for r in balance.resample(df, "k", "c", "v", "smote_tomek", {0: 31, 1: 20}).collect()}
    both = balance.resample(df, "k", "c", "v", "smote", {0: 31, 1: 20})
    linked = {r["k"] for r in balance.tomek_links(both, "k", "c", "v").collect()}
    assert linked and kept == {r["k"] for r in both.collect()} - linked
    with pytest.raises(ValueError):
        balance.resample(df, "k", "c", "v", "other", {})


def test_sentence_with_profiles(spark):
    verdict = spark.createDataFrame([(1, "a", 0.5, "b", 0.4), (2, "a", 0.9, "b", 0.05)], "k int, prediction string, confidence double, runner_up string, runner_up_confidence double")
    top = spark.createDataFrame([(1, "x", 1, 3.0)], "k int, feature string, place int, value double")
    table = dims.profile_table(spark, [("a", "A", 4, "-", ["b"], "Look."), ("b", "B", 1, "-", [], "Rest.")])
    got = {r["k"]: r["sentence"] for r in narrate.sentences(verdict, top, dims.gloss_table(spark), ["k"], table).collect()}
    assert got[1] == "This record is probably a (50.0%), resting on the x (far above normal). Severity: high. b is nearly as likely (40.0%), which is often taken for it. Next: Look."
    assert got[2] == "This record is very likely a (90.0%). Severity: high. Next: Look."


def test_scan_keeps_the_files_apart(spark, tmp_path):
    for name, text in {"a": "Flow Duration,Label\n1,x\n2,\n", "b": "Flow Duration,Label\n3,y\n", "c": "Label,Flow Duration,Label\nz,4,q\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    parts = tables.scan(spark, tables.discover(spark, str(tmp_path)))
    assert len(parts) == 2
    assert {tuple(r) for r in tables.file_counts(parts, "Label").collect()} == {("a.csv", 2, 1), ("b.csv", 1, 1), ("c.csv", 1, 1)}
    out = tables.consolidate(parts, ["Flow Duration"], "Label", merge_rare=False)
    assert {(r["Flow Duration"], r["Label"]) for r in out.collect()} == {(1.0, "x"), (3.0, "y"), (4.0, "z")}
    (tmp_path / "d.txt").write_text("Flow Duration\n5\n6\n")
    assert tables.read_flow(spark, str(tmp_path / "d.txt"), require_label=False, rows=1).count() == 1
    with pytest.raises(ValueError):
        tables.read_flow(spark, str(tmp_path / "d.txt"))


def test_report_checks_its_probabilities(spark):
    codec = dims.class_table(spark, ["x", "y"])
    rows = lambda *p: spark.createDataFrame([(0, list(x)) for x in p], "code int, proba array<double>")
    out = {r["metric"]: r["value"] for r in evaluate.summary(evaluate.evaluate(rows((3.0, 1.0), (1.0, 3.0), (0.0, 0.0)), codec, 0)).collect()}
    assert out["rows"] == 3 and out["accuracy"] == pytest.approx(2 / 3, abs=1e-6) and out["top_2"] == 1.0
    for bad in ((-1.0, 2.0), (float("nan"), 1.0), (1.0,)):
        with pytest.raises(Exception, match="probabilities"):
            evaluate.evaluate(rows(bad), codec, 0)


def test_models_of_several_splits_are_marked(spark):
    df = spark.createDataFrame([("a", 0.5, "test"), ("b", None, "val")], "model string, f1 double, split string")
    assert [(r["model"], r["rank"], r["mixed_split"]) for r in evaluate.compare(df, "f1", ["model"]).collect()] == [("a", 1, True), ("b", 2, True)]


def test_numbers_follow_the_order(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("a"), F.col("id").alias("b")).repartition(5)
    got = sorted((r["number"], r["a"], r["b"]) for r in numbered(df, ["a", "b"]).collect())
    assert [g[0] for g in got] == list(range(500)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert numbered(df.limit(0), ["a"]).count() == 0


def test_bootstraps_weigh_rows(spark):
    """ANOVA of weighed rows is that of repeated rows, far from 0 and with nulls, and stability repeats no row."""
    from flowlens.operators.sample import bootstrap, bootstrap_times

    rows = [(i, None if i % 17 == 0 else 1e6 + i % 7, float(i * i % 11), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, x double, y double, c string")
    weighed = bootstrap_times(df, ["k"], "s", 3)
    assert weighed.groupBy("k", "replicate").count().where("count > 1").count() == 0
    assert weighed.agg(F.sum("_times")).first()[0] == bootstrap(df, ["k"], "s", 3).count() > 1000
    want = {(r["replicate"], r["feature"]): r["score"] for r in select.anova(bootstrap(df, ["k"], "s", 3), ["x", "y"], "c", ["replicate"]).collect()}
    got = {(r["replicate"], r["feature"]): r["score"] for r in select.anova(weighed, ["x", "y"], "c", ["replicate"], "_times", [1e6, 5.0]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-9) for k in want)


def test_queue_filters_scored_rows_once(spark):
    """The conditions of the queue stay above the scoring: its plan ranks the classes once, as that of the verdicts does."""
    df = spark.createDataFrame([(i, [0.5, 0.3 + i / 1000, 0.2 - i / 1000]) for i in range(20)], "k int, proba array<double>")
    table = score.verdicts(df, ["a", "b", "c"], "a").withColumn("severity", F.col("pred"))
    ranks = lambda t: t._jdf.queryExecution().optimizedPlan().toString().count("array_sort")
    queue = score.queue(table, True, True, 5, ["k"])
    assert ranks(queue) <= ranks(table)
    assert [r["k"] for r in queue.collect()] == [r["k"] for r in table.where("is_attack and status = 'review'").orderBy(F.desc("severity"), F.desc("attack_probability"), "k").limit(5).collect()]


def test_fits_of_trees_deal_rows(spark):
    """No partition of a fit holds many more rows than stated, however the input is cut; none is lost."""
    rows = spark.range(5000).coalesce(1)
    sizes = [len(p) for p in models.dealt(rows, 500).rdd.glom().collect()]
    assert len(sizes) == 10 and sum(sizes) == 5000 and max(sizes) <= 600
    assert models.dealt(rows, 5000).rdd.getNumPartitions() == 1
