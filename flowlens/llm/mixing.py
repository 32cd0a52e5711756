"""Mixing sources to target weights.

Each source is cut into blocks of texts by hash. Its target becomes an exact quota of block draws:
whole passes over its blocks, then blocks in permuted order up to the target, the last one in part.
A splitting tree halves the output shards and the vector of quotas with multivariate hypergeometric
draws; leaves are shards with exact quotas. Each shard takes the next disjoint range of every
source's permuted blocks and shuffles its texts by hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.storage import stored
from flowlens.llm.textops import fresh

WORD = r"[^\x20\x09-\x0D]+"
#: Subtrees of the splitting tree at least, and shards of a subtree at most.
SUBTREES, LEAVES = 64, 4096
RUN = 1_000_000  # copies numbered at once
MOST = 900_000_000


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with source_no: its rows counted from 0 in order, range by range."""
    spread = df.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    spread = stored(spread, "mix-order")
    upto = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = spread.groupBy("range").agg(F.count("*").alias("n")).select("range", (upto - F.col("n")).alias("before"))  # a row a shuffle partition
    at = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return spread.join(F.broadcast(before), "range").withColumn("source_no", (F.col("before") + at).cast("long")).drop("range", "before")


def targets(sources: DataFrame, weights: tuple[float, ...], most: float = 3.0) -> DataFrame:
    """sources (source, source_size, ...) with source_no, weight and target.

    Sources by code point, null last, have `weights` in turn. The sum of sizes is shared by weight;
    what exceeds `most` times a size is shared again among the rest.
    """
    known = numbered(sources, F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    known = stored(known.withColumn("weight", F.get(cycle, (F.col("source_no") % len(weights)).cast("int"))), "mix-sources")
    cap = F.lit(most) * F.col("source_size")
    total = float(known.agg(F.sum("source_size")).first()[0] or 0)
    unit, full = 0.0, -1
    while True:  # the unit grows with each source found full, until no other is
        over = F.col("weight") * F.lit(unit) > cap
        open_ = ~over & (F.col("source_size") > 0)
        r = known.agg(F.sum(F.when(over, F.col("source_size"))).alias("size"), F.count(F.when(over, 1)).alias("n"), F.sum(F.when(open_, F.col("weight"))).alias("weight")).first()
        if r["n"] == full or not r["weight"]:
            break
        full, unit = r["n"], (total - most * (r["size"] or 0)) / r["weight"]
    share = F.when(F.col("source_size") > 0, F.least(F.col("weight") * F.lit(unit), cap)).otherwise(F.lit(0.0))
    return known.withColumn("target", share)


def halve(quotas: np.ndarray, shards: int, seed: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Quotas of the left and right half of the shards, and the number of left shards."""
    left = shards // 2
    part = int(quotas.sum()) * left // shards
    rng = np.random.Generator(np.random.Philox(np.random.SeedSequence(seed)))
    drawn, n = np.zeros_like(quotas), int(quotas.sum()) // MOST + 1
    for k in range(n):  # numpy draws from fewer than 10**9 at once; more are cut in equal parts
        own = quotas * (k + 1) // n - quotas * k // n
        drawn += rng.multivariate_hypergeometric(own, part * (k + 1) // n - part * k // n, method="marginals")
    return drawn, quotas - drawn, left


def split(quotas: np.ndarray, first: int, shards: int, seed: int, until: int = 1) -> Iterator[tuple[int, int, np.ndarray]]:
    """Leaves (first shard, shards, quotas) of the splitting tree with `until` shards or fewer."""
    if shards <= until:
        yield first, shards, quotas
        return
    a, b, n = halve(quotas, shards, (seed, first, shards))
    yield from split(a, first, n, seed, until)
    yield from split(b, first + n, shards - n, seed, until)


def running(df: DataFrame, first: list[str], rank: str, value: str) -> DataFrame:
    """df with upto: the sum of value over the rows of a source up to this one, by first, then rank.

    rank is a hash. Rows are summed within 4,096 ranges of it, and the sums of earlier ranges added.
    """
    cut = df.withColumn("range", F.shiftright(rank, 52))
    inside = [*first, "range"]
    sums = cut.groupBy("source_no", *inside).agg(F.sum(value).alias("own"))
    upto = F.sum("own").over(Window.partitionBy("source_no").orderBy(*inside).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = sums.select("source_no", *inside, (upto - F.col("own")).alias("earlier"))
    own = F.sum(value).over(Window.partitionBy("source_no", *inside).orderBy(rank, "block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cut.join(sums, ["source_no", *inside]).withColumn("upto", F.col("earlier") + own).drop("range", "earlier")


@dataclass(frozen=True)
class Mix:
    """units: (id, source, size, copy, source_no, block), a row per row; draws: (id, source, size, copy, epoch, shard, slot); sources: a row each."""

    units: DataFrame
    draws: DataFrame
    sources: DataFrame


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    most: float = 3.0,
    block_words: int = 20_000,
    block_texts: int = 200,
    shard_words: int = 1_000_000,
    seed: int = 17,
) -> Mix:
    """Which texts a mix takes, how often and into which shard.

    Sources go by code point, null last, and weigh `weights` in turn. The words taken of a source
    miss its target by less than the smallest text that the last block had left. A row is taken
    `most` times at most. Null and empty texts have no words and may be drawn without effect. Rows
    equal in id, source and number of words are numbered and drawn apart. Null ids and sources are
    values like others. All choices follow from hashes of ids, numbers and the seed, so reruns agree.
    A block has about `block_words` words and `block_texts` texts at least. An empty table gives an
    empty mix. Other columns are ignored. The driver holds one number a source.
    """
    spark = df.sparkSession
    sized = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    groups = stored(sized.groupBy("id", "source", "size").agg(F.count("*").alias("copies")), "mix-units")
    per = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("texts"))
    sources = targets(per, weights, most)
    n, goal = F.col("source_size"), F.col("target")
    passes = F.when(n > 0, F.least(F.floor(goal / n + 1e-9), F.lit(math.floor(most)))).otherwise(0).cast("int")
    blocks = F.greatest(F.lit(1), F.least(F.ceil(n / block_words), F.floor(F.col("texts") / block_texts)))
    sources = sources.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0), F.rint(goal).cast("long") - F.col("passes") * n)).withColumn("blocks", blocks)
    sources = stored(sources.select("source_no", "source", "source_size", "target", "passes", "rest", "blocks"), "mix-targets")
    part = groups.withColumn("part", F.explode(F.expr(f"sequence(0L, (copies - 1) div {RUN})")))
    every = part.withColumn("copy", F.explode(F.expr(f"sequence(part * {RUN}, least(copies, (part + 1) * {RUN}) - 1)"))).alias("u")
    placed = every.join(sources.alias("s"), F.expr("u.source <=> s.source")).select(
        "u.id", "u.source", "u.size", "u.copy", "source_no", "rest", "passes", F.pmod(F.xxhash64(F.lit(seed), "u.id", "u.copy"), F.col("blocks")).alias("block")
    )

    def rank(*what: str | Column) -> Column:
        return F.xxhash64(F.lit(seed + 1), *what)

    # The last, partial pass: blocks in permuted order.
    blocks = placed.groupBy("source_no", "passes", "rest", "block").agg(F.sum("size").alias("words"))
    blocks = stored(running(blocks.withColumn("rank", rank("source_no", "passes", "block")), [], "rank", "words"), "mix-blocks")
    before = F.col("upto") - F.col("words")
    whole = blocks.select("source_no", "block", F.explode(F.expr("if(passes > 0, sequence(0, passes - 1), array())")).alias("epoch"), F.lit(False).alias("part"))
    last = blocks.where(before < F.col("rest")).select("source_no", "block", F.col("passes").alias("epoch"), (F.col("upto") > F.col("rest")).alias("part"))
    draws = whole.union(last).withColumn("rank", rank("source_no", "epoch", "block")).withColumn("one", F.lit(1))
    draws = running(draws, ["epoch", "part"], "rank", "one").select("source_no", "block", "epoch", "part", (F.col("upto") - 1).alias("turn"))
    draws = stored(draws, "mix-draws")

    # Exact quotas of block draws, split among the shards.
    quota = draws.groupBy("source_no").agg(F.count("*").alias("n")).toPandas()
    vector = np.zeros(sources.count(), dtype=np.int64)
    vector[quota["source_no"].to_numpy(dtype=np.int64)] = quota["n"]
    shards = max(1, math.ceil((sources.agg(F.sum("target")).first()[0] or 0) / shard_words))
    tops = list(split(vector, 0, shards, seed, until=max(1, min(LEAVES, math.ceil(shards / SUBTREES))))) if len(vector) else []
    nodes = [(first, n, no, int(got[no])) for first, n, got in tops for no in np.flatnonzero(got).tolist()]
    top = spark.createDataFrame(nodes, "first int, shards int, source_no long, quota long")

    def leaves(node: pa.Table) -> pa.Table:
        node = node.sort_by("source_no")
        nos, quotas = node.column("source_no").to_numpy(), node.column("quota").to_numpy()
        first, n = node.column("first")[0].as_py(), node.column("shards")[0].as_py()
        out = [(shard, nos[got > 0], got[got > 0]) for shard, _, got in split(quotas, first, n, seed)]
        number = np.repeat([x[0] for x in out], [len(x[1]) for x in out])
        return pa.table({"shard": pa.array(number, pa.int32()), "source_no": pa.array(np.concatenate([x[1] for x in out]), pa.int64()), "quota": pa.array(np.concatenate([x[2] for x in out]), pa.int64())})

    leaf = top.groupBy("first", "shards").applyInArrow(leaves, "shard int, source_no long, quota long")
    upto = F.sum("quota").over(Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    turns = leaf.withColumn("upto", upto).select("shard", "source_no", F.explode(F.expr("sequence(upto - quota, upto - 1)")).alias("turn"))
    dealt = stored(draws.join(turns, ["source_no", "turn"]).select("source_no", "block", "epoch", "part", "shard"), "mix-dealt")

    # Of the last block of a source, the texts that still fit, in hash order.
    room = blocks.where((before < F.col("rest")) & (F.col("upto") > F.col("rest"))).select("source_no", "block", (F.col("rest") - before).alias("room"))

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("by", "ascending"), ("size", "ascending"), ("copy", "ascending")])
        left, keep = rows.column("room")[0].as_py(), []
        for n in rows.column("size").to_pylist():
            keep.append(n <= left)
            left -= n if n <= left else 0
        return rows.filter(pa.array(keep, pa.bool_())).select(["id", "source", "size", "copy", "source_no", "block"])

    unit = ["id", "source", "size", "copy"]
    inside = placed.join(room, ["source_no", "block"]).select(*unit, "source_no", "block", "room", rank("id", "copy").alias("by"))
    kind = dict(groups.dtypes)["id"]
    fitting = inside.groupBy("source_no").applyInArrow(fill, f"id {kind}, source string, size long, copy long, source_no long, block long")
    columns = [*unit, "epoch", "shard"]
    taken = placed.join(dealt.where(~F.col("part")), ["source_no", "block"]).select(*columns)
    taken = taken.union(fitting.join(dealt.where("part"), ["source_no", "block"]).select(*columns))
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "shard", "epoch", "id", "copy"), "id", "copy", "epoch", "source", "size")
    return Mix(placed.select(*unit, "source_no", "block"), taken.withColumn("slot", F.row_number().over(shuffled)), sources)


def amounts(m: Mix) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every row: the words taken, repeats counted."""
    n = m.draws.groupBy("id", "source", "size", "copy").agg(F.count("*").alias("n"))
    u = m.units.alias("u").join(n.alias("n"), F.expr("u.id <=> n.id and u.source <=> n.source and u.size = n.size and u.copy = n.copy"), "left")
    out = u.join(m.sources.select("source_no", "source_size", "target"), "source_no")
    return out.select("u.id", "u.source", "u.size", "source_size", "target", (F.coalesce("n.n", F.lit(0)) * F.col("u.size")).cast("long").alias("taken"))


def mixed(df: DataFrame, m: Mix, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of df as the mix takes them, with mix_shard, mix_slot and mix_epoch.

    Columns of df with these names, in any case, are replaced. Rows equal in id, source and number of
    words get their numbers by a hash of their text; where texts are equal too, either may have either.
    """
    new = {"shard": "mix_shard", "slot": "mix_slot", "epoch": "mix_epoch"}
    names = [c for c in df.columns if c.lower() not in new.values()]
    size, copy, drawn = fresh(df, "_mix_size"), fresh(df, "_mix_copy"), m.draws
    left = df.select(*names).withColumn(size, F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long"))
    many = stored(m.units.where("copy = 1").select("id", "source", "size"), "mix-repeated")
    same = F.col(f"l.`{id_col}`").eqNullSafe(F.col("d.id")) & F.col(f"l.`{source_col}`").eqNullSafe(F.col("d.source")) & (F.col(f"l.`{size}`") == F.col("d.size"))
    if many.isEmpty():
        left = left.withColumn(copy, F.lit(0).cast("long"))
    else:
        group = Window.partitionBy(id_col, source_col, size).orderBy(F.xxhash64(text_col))
        again = left.alias("l").join(many.alias("d"), same, "left_semi").withColumn(copy, (F.row_number().over(group) - 1).cast("long"))
        left = left.alias("l").join(many.alias("d"), same, "left_anti").withColumn(copy, F.lit(0).cast("long")).unionByName(again)
    out = left.alias("l").join(drawn.alias("d"), same & (F.col(f"l.`{copy}`") == F.col("d.copy")))
    return out.select(*(F.col(f"l.`{c}`") for c in names), *(F.col(f"d.{c}").alias(name) for c, name in new.items()))
