"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v): component is the smallest node reachable.

    In each round a node joins the neighbour (or itself) of the smallest hash; the hash changes by
    round, so that paths shrink by a constant factor too. No edge, node or label goes to the driver.
    """
    edges = stored(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "graph-edges")
    labels = None
    for turn in range(100):
        if edges.isEmpty():
            break
        both = edges.union(edges.select("v", "u"))
        rank = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c).alias("h"), F.col(c).alias("n"))
        near = both.groupBy("u").agg(F.min(rank("v")).alias("b")).select(F.col("u").alias("at"), F.least("b", rank("u"))["n"].alias("to"))
        near = stored(near, "graph-near")
        if labels is None:
            labels = near.select(F.col("at").alias("node"), F.col("to").alias("root"))
        else:
            joined = labels.join(near, labels["root"] == near["at"], "left")
            labels = stored(joined.select("node", F.coalesce("to", "root").alias("root")), "graph-labels")
        a, b = near.select(F.col("at").alias("u"), F.col("to").alias("x")), near.select(F.col("at").alias("v"), F.col("to").alias("y"))
        moved = edges.join(a, "u").join(b, "v").where("x != y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
        edges = stored(moved.distinct(), "graph-edges")
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return stored(labels.join(least, "root").select("node", "component"), "graph-components")
