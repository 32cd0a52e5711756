"""Structured Streaming over the same operators.

Results go to files and checkpoints to the shared folder (see sources.stage), never to the driver.
Windows and sessions run in append mode: a watermark closes them and frees their state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.functions.local import local_table
from flowlens.operators.sample import bernoulli
from flowlens.sources.stage import new_folder

KEPT = 10_000
END = "9999-01-01 00:00:00"


def read_stream(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """A Parquet file, or a folder of them, as a stream: `files` at a time, or all there are."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, for a plain path must be a folder


def closed(df: DataFrame, ts: str) -> DataFrame:
    """A finite stream with one more row, at the end of time and null elsewhere.

    It moves the watermark past every window, so that append mode gives all of them when the stream
    ends; its own window never closes. Call it before event_time().
    """
    spark = df.sparkSession
    path = new_folder(spark, "stream-end")
    spark.range(1).select(*(F.lit(END if f.name == ts else None).cast(f.dataType).alias(f.name) for f in df.schema)).write.parquet(path)
    return df.unionByName(read_stream(spark, path, df.schema))


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """df with a watermark; the time column must be a timestamp with zone for that."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tally(df: DataFrame, label: str) -> DataFrame:
    """Running rows by class; for complete or update mode."""
    return df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))


def sampled(df: DataFrame, label: str, key: Sequence[str], rates: dict[str, float], seed: str) -> DataFrame:
    """Rows kept at a rate by class: stateless, and the same after a restart."""
    return bernoulli(df, label, key, rates, seed)


def deduplicated(df: DataFrame, key: Sequence[str], ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark, which bounds the state."""
    return event_time(df, ts, delay).dropDuplicatesWithinWatermark(list(key))


def distinct_windows(df: DataFrame, key: Sequence[str], label: str, ts: str = "ts", delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, end, class, n) of distinct keys: de-duplication feeds windows in one append query. Both
    states go by the same watermark; a row behind it is dropped by the first and counted in its progress."""
    return windowed(deduplicated(df, key, ts, delay), label, ts, size)


def windowed(df: DataFrame, label: str, ts: str = "ts", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, end, class, n); df has a watermark on ts in a stream."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = df.groupBy(window.alias("w"), F.col(label).alias("class")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "class", "n")


def sessions(df: DataFrame, source: str, ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """(source, start, end, n) of runs of events with less than `gap` between them."""
    out = df.groupBy(F.session_window(ts, gap).alias("w"), source).agg(F.count("*").alias("n"))
    return out.select(source, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def keep_progress(query: StreamingQuery, path: str) -> None:
    """Appends to a Parquet table, for each batch and stateful operator of a query that has ended, the rows
    it read and those it dropped as late: (run, batch, operator, position, rows_in, late)."""
    rows = []
    for p in query.recentProgress:
        for at, op in enumerate(p["stateOperators"]):
            rows.append((str(p["runId"]), int(p["batchId"]), op["operatorName"], at, int(p["numInputRows"]), int(op["numRowsDroppedByWatermark"])))
    spark = SparkSession.active()
    local_table(spark, rows, "run string, batch long, operator string, position int, rows_in long, late long").coalesce(1).write.mode("append").parquet(path)


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """(operator, position, late) over all runs of a progress table."""
    return spark.read.parquet(path).groupBy("operator", "position").agg(F.sum("late").alias("late"))


def run_available(df: DataFrame, mode: str = "append", folder: str | None = None, checkpoint: str | None = None, progress: str | None = None) -> DataFrame:
    """Runs a stream over what is there now, and reads its result from `folder` (default: a new one).
    progress: a table that keep_progress() adds the run's batches to, KEPT of them at most.

    Append mode uses the file sink. In complete mode each batch writes the whole result so far to a
    folder of its own, over what a lost attempt of it left, and the last one is read; in update mode
    all are read, with their number as `batch`. `checkpoint` defaults to a folder beside the result.
    """
    spark = df.sparkSession
    folder = (folder or new_folder(spark, "stream")).rstrip("/")
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{folder}-checkpoint")

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    had = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", str(KEPT))
    query = writer.format("parquet").start(folder) if mode == "append" else writer.foreachBatch(add).start()
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", had)
    query.awaitTermination()
    if progress:
        keep_progress(query, progress)
    if mode == "append":
        return spark.read.schema(df.schema).parquet(folder)
    out = spark.read.parquet(folder)
    return out if mode == "update" else out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).drop("batch")


def evaluate_batches(df: DataFrame, state: str, code: str = "code", proba: str = "proba", checkpoint: str | None = None) -> StreamingQuery:
    """Appends each micro-batch's confusion counts, by batch number, to the Parquet folder `state`.

    A batch that runs again replaces its own counts, so the sums (see confusion_so_far) stay right.
    `checkpoint` defaults to a folder beside the state.
    """
    from flowlens.operators.evaluate import known, predicted

    def add(batch: DataFrame, number: int) -> None:
        n = known(batch, code).groupBy(F.col(code).alias("code"), predicted(proba).alias("pred")).agg(F.count("*").alias("n"))
        n.write.mode("overwrite").parquet(f"{state.rstrip('/')}/batch={number}")

    writer = df.writeStream.foreachBatch(add).trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint or f"{state.rstrip('/')}-checkpoint").start()


def confusion_so_far(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.parquet(state).groupBy("code", "pred").agg(F.sum("n").alias("n"))
