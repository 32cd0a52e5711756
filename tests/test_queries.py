"""Queries against their SQL twins on the smallest tables with unique keys."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from flowlens.plans import catalog

FAST = [
    "normalise_labels", "coerce_numbers", "clean_rows", "clean_report", "audit_counts", "capped_sample", "two_pass_sample", "budgeted_sample", "stratified_split", "stratified_folds",
    "holdout", "bootstrap", "prep_fit_robust", "prep_transform_standard", "prep_inverse", "class_weights_balanced", "rank_anova", "rank_chi2", "rank_mutual_information", "correlations", "correlations_wide", "model_bayes", "exact_quantiles", "prep_fit_standard", "one_vs_rest_areas", "macro_areas",
    "oversample", "verdict_table", "repair_report", "verdict_overview", "triage", "class_metrics", "top_k_accuracy", "calibration_error",
    "areas_with_ties", "binary_metrics", "threshold_sweep", "recommended_thresholds", "permutation_importance", "permutation_importance_f1", "recall_drop", "evaluation_report", "sampling_report", "prune_correlated", "rank_stability", "prep_constant", "knn_impute",
    "stream_tally", "stream_scoring", "stream_evaluation", "stream_sample", "stream_dedup", "stream_windows", "stream_sliding_windows", "stream_sessions",
]


@pytest.fixture(scope="module")
def tables(small):
    db = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        db.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return db


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    one = lambda x: None if x is pd.NA or x is None or (isinstance(x, float) and x != x) else round(float(x), 9) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)
    return sorted((tuple(one(x) for x in r) for r in pdf.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", FAST)
def test_same_as_sql(spark, small, tables, name):
    got = catalog.QUERIES[name](spark, small).toPandas()
    want = tables.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_registry_names_its_oracles():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 100


@pytest.mark.parametrize("name", ["stream_tally", "stream_windows", "stream_sessions", "stream_dedup"])
def test_streams_over_a_folder_of_files(spark, small, tables, name, tmp_path):
    """A table of many part files, in no order of time, gives what a single file gives."""
    spark.read.parquet(f"{small}/events.parquet").repartition(7, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert len(got) and rows(got) == rows(tables.execute(catalog.ORACLES[name]).df())
