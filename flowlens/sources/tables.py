"""Readers and writers of record tables."""

from __future__ import annotations

import codecs
import csv
import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.local import local_table
from flowlens.operators.normalise import canonical_columns, column_name, drop_identifiers, merged, normalise_labels, numbers
from flowlens.sources import dims
from flowlens.sources.stage import moved

CHARSET = "ISO-8859-1"


def discover(spark: SparkSession, folder: str) -> list[str]:
    """CSV files below a folder, sorted, dot files left out; an error if there is none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder).select("path")
    paths = sorted(r["path"] for r in found.collect() if not r["path"].rpartition("/")[2].startswith("."))
    if not paths:
        raise FileNotFoundError(f"no CSV file below {folder}")
    return paths


#: Bytes of a file's head that are read at a time, and paths that one task opens, about.
HEAD_BYTES, PATHS = 1 << 16, 64


def _head(path: str, charset: str) -> list[str] | None:
    """The cells of a file's first line that isn't blank; only so much is read, unpacked if it is compressed."""
    files, place = fs.FileSystem.from_uri(quote(path, safe=":/%") if urlsplit(path).scheme else f"file://{quote(path)}")
    text, decode = "", codecs.getincrementaldecoder(charset)()
    with files.open_input_stream(place) as stream:
        while True:
            part = stream.read(HEAD_BYTES)
            text = (text + decode.decode(part, not part)).lstrip("\r\n")
            if not part or "\n" in text or "\r" in text[:-1]:
                break
    line = next((x for x in text.splitlines() if x.strip()), None)
    return None if line is None else next(csv.reader([line.lstrip("\ufeff")]))


def headers(spark: SparkSession, paths: Sequence[str], charset: str = CHARSET) -> DataFrame:
    """(path, header): the first line's cells of many CSV files, null of empty ones, in one job whose
    tasks read the heads alone. For file systems that pyarrow opens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_head(p, charset) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(got, pa.list_(pa.string()))], ["path", "header"])

    table = local_table(spark, [(p,) for p in paths], "path string")
    return table.repartition(max(1, -(-len(paths) // PATHS))).mapInArrow(run, "path string, header array<string>")


def header(spark: SparkSession, path: str, charset: str = CHARSET) -> list[str]:
    """The cells of a CSV file's first line, which readers rename where they repeat."""
    head = spark.read.option("encoding", charset).option("header", False).option("inferSchema", False).csv(path).first()
    if head is None:
        raise ValueError(f"{path} is empty")
    return ["" if h is None else h for h in head]


def read_csv(spark: SparkSession, path: str | list[str], charset: str = CHARSET, file: str | None = None, raw: Sequence[str] | None = None) -> DataFrame:
    """A CSV table, all cells as text, under its own headers; repeated headers keep their first column.

    Several files must have one header; raw: that header, if known. file: a column to take the path of each row's file.
    """
    raw = header(spark, path if isinstance(path, str) else path[0], charset) if raw is None else raw
    names = [f"_c{i}" for i in range(len(raw))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", charset).csv(path)
    keep, seen = [], set()
    for i, h in enumerate(raw):
        if column_name(h) not in seen:
            seen.add(column_name(h))
            keep.append(F.col(names[i]).alias(h))
    return df.select(*keep, *([F.col("_metadata.file_path").alias(file)] if file else []))


def read_flow(spark: SparkSession, path: str, label: str = dims.LABEL, require_label: bool = True, rows: int | None = None, charset: str = CHARSET) -> DataFrame:
    """A flow CSV under canonical headers; without a label column an error, or, if none is required, a
    null one. rows: at most so many of the first."""
    named, _ = canonical_columns(read_csv(spark, path, charset))
    if label not in named.columns:
        if require_label:
            raise ValueError(f"{path} has no column {label}")
        named = named.withColumn(label, F.lit(None).cast("string"))
    return named if rows is None else named.limit(rows)


def scan(spark: SparkSession, paths: Sequence[str], charset: str = CHARSET, file: str = "source_file") -> list[DataFrame]:
    """The tables of many files, one for each header among them, with the file of each row. Headers come
    from one job, grouped there; the driver holds the paths, as any reader of them does."""
    found = headers(spark, paths, charset).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    empty = [p for r in found if r["header"] is None for p in r["paths"]]
    if empty:
        raise ValueError(f"{min(empty)} is empty")
    return [read_csv(spark, r["paths"], charset, file, r["header"]) for r in sorted(found, key=lambda r: r["paths"][0])]


def file_counts(parts: Sequence[DataFrame], label: str, file: str = "source_file") -> DataFrame:
    """(file, rows, labelled) of scanned tables."""
    out = None
    for part in parts:
        named, _ = canonical_columns(part)
        there = F.count_if(F.trim(F.col(label)) != "") if label in named.columns else F.lit(0).cast("long")
        n = named.groupBy(F.element_at(F.split(F.col(file), "/"), -1).alias("file")).agg(F.count("*").alias("rows"), there.alias("labelled"))
        out = n if out is None else out.unionByName(n)
    return out


def read_table(spark: SparkSession, path: str, charset: str = CHARSET) -> DataFrame:
    """A table by its suffix: Parquet, ORC, JSON lines, else CSV (also gzip); unnamed columns go."""
    low = path.rstrip("/").lower()
    if low.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif low.endswith(".orc"):
        df = spark.read.orc(path)
    elif low.endswith((".json", ".jsonl", ".json.gz")):
        df = spark.read.json(path)
    else:
        df = read_csv(spark, path, charset)
    return df.drop(*(c for c in df.columns if c.strip().lower().startswith("unnamed:")))


def consolidate(parts: Sequence[DataFrame], features: Sequence[str], label: str, merge_rare: bool = True, text: bool = True) -> DataFrame:
    """All tables as one under canonical headers: the features in order, absent ones null, then the
    label; rows without a label go."""
    whole = None
    for part in parts:
        named, _ = canonical_columns(part)
        named, _ = drop_identifiers(named)
        if label not in named.columns:
            raise ValueError(f"a table has no column {label}")
        named = named.select(*(c for c in named.columns if c in set(features) or c == label))
        whole = named if whole is None else whole.unionByName(named, allowMissingColumns=True)
    have = set(whole.columns)
    out = whole.select(*((F.col(f"`{f}`") if f in have else F.lit(None).cast("string" if text else "double")).alias(f) for f in features), label)
    out = numbers(out, features) if text else out
    out = normalise_labels(out, label, merge_rare=False)
    if merge_rare:
        out = out.withColumn(label, merged(F.col(label)))
    return out.where(F.col(label).isNotNull())


def load_flows(spark: SparkSession, folder: str, merge_rare: bool = True) -> DataFrame:
    """The flow table of a folder of raw CSV files."""
    return consolidate(scan(spark, discover(spark, folder)), dims.FEATURES, dims.LABEL, merge_rare)


def missing_files(spark: SparkSession, folder: str, expected: Sequence[str] = tuple(dims.EXPECTED_FILES)) -> DataFrame:
    """Expected files that the folder lacks."""
    names = local_table(spark, [(p.rpartition("/")[2].replace("%20", " "),) for p in discover(spark, folder)], "file string")
    return local_table(spark, [(f,) for f in expected], "file string").join(names, "file", "left_anti")


def settings_digest(settings: dict) -> str:
    """A name for the settings that change a result."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]


def cached_split(spark: SparkSession, folder: str, settings: dict, make) -> DataFrame:
    """make() once per settings: its table is written beside its place below `folder`, moved there when
    whole, and read again later."""
    path = f"{folder.rstrip('/')}/split-{settings_digest(settings)}"
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    make().write.parquet(staging)
    moved(spark, staging, path)
    return spark.read.parquet(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """A Parquet folder for each table of a run."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def write_verdicts(verdicts: DataFrame, path: str, kind: str = "csv") -> None:
    """One row per row scored."""
    writer = verdicts.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def labelled_sample(df: DataFrame, key: Sequence[str], n: int, seed: str = "sample") -> DataFrame:
    """The first n rows of the test split by hash order."""
    from flowlens.functions.portable import key_hash

    return df.where("split = 'test'").orderBy(key_hash(seed, key), *key).limit(n)
