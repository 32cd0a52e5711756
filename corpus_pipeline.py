"""A training corpus from raw documents: language, lines, near copies, benchmark leaks, mixture.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns of `docs`; the last adds mix_shard, mix_slot and mix_epoch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.decontaminate import drop_leaks, find_leaks
from flowlens.llm.language_id import fit, held_out, identify
from flowlens.llm.line_dedup import dedup_lines
from flowlens.llm.mixing import mix, mixed
from flowlens.llm.ngram_join import drop_near_copies, jaccard_components
from flowlens.llm.storage import stored
from flowlens.llm.textops import fresh

#: SQL can't express these stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def _shielded(docs: DataFrame, new: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(docs), with columns of docs that an operator would replace kept aside and put back."""
    aside = {}
    for c in docs.columns:
        if c.lower() in new:
            aside[c] = fresh(docs, f"_kept_{c}")
    out = run(docs.withColumnsRenamed(aside))
    return out.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: out go texts without a letter, null texts and near ties of languages.

    Rows are judged one by one, so repeated rows and ids stay together. Without a labelled row nothing
    is learned and all texts with a letter stay.
    """
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    rejected = (F.coalesce("lang_pred", F.lit("")) == "und") | (F.col("ambiguous") & (F.col("score") < 0.5) & F.col("lang_pred").isNotNull())
    return _shielded(docs, ["lang_pred", "score", "ambiguous"], lambda d: identify(d, model).where(~rejected))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated line chunks; n_chars follows the text, and what has no word left goes.

    Null ids and texts stay as they are; rows of one id count as one document (see dedup_lines).
    """

    def run(d: DataFrame) -> DataFrame:
        out = dedup_lines(d).where((F.col("n_lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
        if "n_chars" not in d.columns:
            return out
        return out.withColumn("n_chars", F.when(F.col("n_lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))

    return _shielded(docs, ["n_lines", "n_lines_removed", "n_chunks_removed"], run)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that with the smallest id.

    Rows with a null id, and texts without a word, stay; rows that share the smallest id all stay.
    """
    return drop_near_copies(docs, jaccard_components(docs))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null texts and ids stay; of rows with one id all go if one has a passage.
    """
    return drop_leaks(docs, find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and in the shards that the mixture takes them.

    A null source is a source; equal rows are drawn apart; texts without a word may come or not.
    Columns named mix_shard, mix_slot and mix_epoch are replaced.
    """
    return mixed(docs, mix(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_copy_stage),
    ("decontaminate", benchmark_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stage's result stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, f"pipeline-{name}")
    return docs
