"""Labelled tables derived from the given ones, in Spark and as SQL.

LI: lineitem as an imbalanced labelled table. LID: LI with infinite, NaN, null, negative and repeated
cells and rows. PR: LI with class probabilities. EM: embeddings as one column per dimension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.portable import hash_int, once
from flowlens.sources import dims

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CLASSES = ["base", "deep", "big", "rare"]
BENIGN = "base"
PROFILES = [
    ("base", "Normal", 1, "-", [], "Nothing to do."),
    ("deep", "Discount", 2, "Price", ["base"], "Check the discount."),
    ("big", "Volume", 4, "Stock", ["rare", "deep"], "Check the stock."),
    ("rare", "Rare", 5, "Multiple", ["base"], "Investigate manually."),
]
DIMENSIONS = 64
EM_FEATURES = [f"e{i}" for i in range(DIMENSIONS)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def li(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """rows: lineitem, if not to be read as a table."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    label = F.when((q >= 49) & (d >= 0.1), "rare").when(q >= 45, "big").when(d >= 0.09, "deep").otherwise("base")
    rows = table(spark, folder, "lineitem") if rows is None else rows
    return rows.select(*KEY, *FEATURES, label.alias("label"))


def lid(spark: SparkSession, folder: str) -> DataFrame:
    rows = once(li(spark, folder), {"_h": hash_int("d", KEY) % 1000})
    h = F.col("_h")
    none = h.between(10, 14)
    out = rows.withColumns({
        "l_quantity": F.when(none, None).when(h.between(35, 36), -F.col("l_quantity")).otherwise(F.col("l_quantity")),
        "l_extendedprice": F.when(none, None).when(h <= 4, F.lit(float("inf"))).when(h <= 9, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")),
        "l_discount": F.when(none, None).otherwise(F.col("l_discount")),
        "l_tax": F.when(none, None).otherwise(F.col("l_tax")),
    })
    times = F.when(h.between(15, 34), 2).otherwise(1)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_h", "_copy")


def pr(spark: SparkSession, folder: str, p: str = "p", b: str = "b", shares: bool = True, rows: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """shares=False: proba as the numbers whose shares the probabilities are. keep: columns of li() to keep."""
    rows = li(spark, folder, rows)
    code = F.array_position(F.array(*(F.lit(c) for c in CLASSES)), F.col("label")).cast("int") - 1
    rows = rows.withColumn("code", code)
    rows = once(rows, {"_b": hash_int(b, KEY) % 100 < 70, **{f"_h{k}": hash_int(f"{p}{k}", KEY) % 97 for k in range(4)}})
    rows = rows.withColumns({f"_r{k}": 1 + F.col(f"_h{k}") + F.when((F.col("code") == k) & F.col("_b"), 150).otherwise(0) for k in range(4)})
    total = F.col("_r0") + F.col("_r1") + F.col("_r2") + F.col("_r3")
    proba = F.array(*(F.col(f"_r{k}") / total if shares else F.col(f"_r{k}").cast("double") for k in range(4)))
    return rows.select(*KEY, *keep, "label", "code", proba.alias("proba"))


def codec(spark: SparkSession) -> DataFrame:
    return dims.class_table(spark, CLASSES)


def profiles(spark: SparkSession) -> DataFrame:
    return dims.profile_table(spark, PROFILES)


def em(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return rows.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIMENSIONS)))


def em_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def em_merged(spark: SparkSession, folder: str) -> DataFrame:
    """em_vectors() with labels 0 to 4 as one class."""
    df = em_vectors(spark, folder)
    return df.withColumn("label", F.when(F.col("label") < 5, F.lit(0)).otherwise(F.col("label")).cast(df.schema["label"].dataType))


_KEY = ", ".join(f"cast({k} as varchar)" for k in KEY)
KEYS = ", ".join(KEY)


def md5(seed: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {_KEY}))"


def h(seed: str) -> str:
    return f"cast('0x' || substr({md5(seed)}, 1, 8) as bigint)"


LI = f"""li as (
  select {KEYS}, l_quantity, l_extendedprice, l_discount, l_tax,
    case when l_quantity >= 49 and l_discount >= 0.1 then 'rare' when l_quantity >= 45 then 'big'
         when l_discount >= 0.09 then 'deep' else 'base' end as label
  from lineitem)"""
LID = f"""{LI}, lih as (select *, {h('d')} % 1000 as h from li), defects as (
  select {KEYS}, label, h,
    case when h between 10 and 14 then null when h between 35 and 36 then -l_quantity else l_quantity end as l_quantity,
    case when h between 10 and 14 then null when h <= 4 then cast('Infinity' as double) when h <= 9 then cast('NaN' as double) else l_extendedprice end as l_extendedprice,
    case when h between 10 and 14 then null else l_discount end as l_discount,
    case when h between 10 and 14 then null else l_tax end as l_tax
  from lih), lid as (select * exclude (h) from defects union all select * exclude (h) from defects where h between 15 and 34)"""


def pr_sql(p: str = "p", b: str = "b", name: str = "pr") -> str:
    raw = ", ".join(f"1 + {h(f'{p}{k}')} % 97 + case when code = {k} and {h(b)} % 100 < 70 then 150 else 0 end as r{k}" for k in range(4))
    return f"""{name}c as (select *, list_position(['base', 'deep', 'big', 'rare'], label) - 1 as code from li),
{name}r as (select *, {raw} from {name}c),
{name} as (select {KEYS}, label, code, r0 / (r0 + r1 + r2 + r3) as p0, r1 / (r0 + r1 + r2 + r3) as p1, r2 / (r0 + r1 + r2 + r3) as p2, r3 / (r0 + r1 + r2 + r3) as p3 from {name}r)"""


PR = f"{LI}, {pr_sql()}"
#: Probabilities as rows: (keys, y, k, p), and the rank of each class in its row.
CELLS = f"""{PR}, cells as (
  select {KEYS}, code as y, k, case k when 0 then p0 when 1 then p1 when 2 then p2 else p3 end as p from pr, (select unnest([0, 1, 2, 3]) as k)),
ranked as (select *, row_number() over (partition by {KEYS} order by p desc, k) as r from cells)"""
VERDICTS = f"""{CELLS}, names as (select unnest(['base', 'deep', 'big', 'rare']) as class, unnest([0, 1, 2, 3]) as code, unnest([0, 2, 4, 5]) as severity),
top as (select a.{', a.'.join(KEY)}, a.y, a.k as pred, a.p as conf, b.k as second, b.p as conf2 from ranked a join ranked b on {' and '.join(f'a.{k} = b.{k}' for k in KEY)} and a.r = 1 and b.r = 2),
verdicts as (
  select {', '.join('t.' + k for k in KEY)}, t.y, n.class as prediction, round_even(t.conf, 6) as confidence, round_even(1 - q.p0, 6) as attack_probability,
    1 - q.p0 >= 0.5 as is_attack, n.severity, m.class as runner_up, round_even(t.conf2, 6) as runner_up_confidence,
    case when t.conf < 0.6 then 'review' else 'ok' end as status, w.class as true_class, t.y = t.pred as correct
  from top t join pr q on {' and '.join(f't.{k} = q.{k}' for k in KEY)} join names n on t.pred = n.code join names m on t.second = m.code join names w on t.y = w.code)"""
