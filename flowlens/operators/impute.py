"""Missing cells from the nearest rows that have them, through an index of boxes.

Rows are cut into parts by a tree whose cuts come from a bounded sample; every row is then placed, and
each part's box - the least and greatest value of each feature, and how many rows have it - is taken
over all of them. The distance counts only features that both rows have, so no metric index fits; but
a box bounds it from below for any set of features. An incomplete row first meets the parts that are
nearest by that bound; the k-th distances found there say which other parts it must meet.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.local import local_table
from flowlens.functions.portable import key_hash
from flowlens.operators.clean import finite
from flowlens.sources.stage import stored

#: Incomplete rows of a block, and rows of a part that one task holds, about.
QUERIES, ROWS = 4096, 65_536
#: Rows and incomplete rows that the cuts are taken from, for each part; cuts change the speed alone.
SAMPLE = 16
#: Sets of present features with parts of their own; rows with other sets share parts.
PATTERNS = 15


def _values(batch: pa.RecordBatch | pa.Table, names: Sequence[str]) -> np.ndarray:
    """Columns as doubles, nulls as NaN."""
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy().astype(float) for c in names], axis=1)


def _spread(x: np.ndarray) -> np.ndarray:
    """The variance of each column's values, 0 where there are fewer than two different ones."""
    there = ~np.isnan(x)
    several = np.where(there, x, np.inf).min(axis=0) < np.where(there, x, -np.inf).max(axis=0)
    n = np.maximum(there.sum(axis=0), 1)
    zero = np.where(there, x, 0.0)
    mean = zero.sum(axis=0) / n
    # a mean is rounded, so equal values may lie beside it
    return np.where(several, np.where(there, (zero - mean) ** 2, 0.0).sum(axis=0) / n, 0.0)


@dataclass
class Tree:
    """Cuts (a row goes right where its value is greater, left where it has none) and sets of present features."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    right: list[int] = field(default_factory=lambda: [0])
    patterns: list[tuple[bool, ...]] = field(default_factory=list)

    @classmethod
    def fit(cls, rows: np.ndarray, asked: np.ndarray, leaves: int) -> Tree:
        """The largest leaf is cut in half by the feature that explains most of the distance, on average
        over the sets of features that incomplete rows have, until there are so many leaves."""
        tree = cls()
        sets, n = np.unique(~np.isnan(rows), axis=0, return_counts=True)
        tree.patterns = [tuple(map(bool, sets[i])) for i in np.argsort(-n, kind="stable")[:PATTERNS]]
        known, share = np.unique(~np.isnan(asked), axis=0, return_counts=True)
        share = share / share.sum()
        heap = [(-len(rows), 0, np.arange(len(rows)))]
        for _ in range(leaves - 1):
            while heap:
                _, node, own = heapq.heappop(heap)
                x = rows[own]
                var = _spread(x)
                part = known * var
                total = part.sum(axis=1, keepdims=True)
                gain = (share[:, None] * np.divide(part, total, out=np.zeros_like(part), where=total > 0)).sum(axis=0)
                best = int(np.argmax(gain))
                if gain[best] > 0:
                    break
            else:
                break
            v = x[:, best]
            cut = float(np.median(v[~np.isnan(v)]))
            if not (v > cut).any():
                cut = float(v[v < cut].max())
            tree.feature[node], tree.cut[node], tree.right[node] = best, cut, len(tree.feature) + 1
            for side in (~(v > cut), v > cut):
                tree.feature.append(-1), tree.cut.append(0.0), tree.right.append(0)
                if side.sum() > 1:
                    heapq.heappush(heap, (-int(side.sum()), len(tree.feature) - 1, own[side]))
        return tree

    def place(self, x: np.ndarray) -> np.ndarray:
        """The part of each row: its leaf, apart for each common set of present features."""
        feature, cut, right = np.array(self.feature), np.array(self.cut), np.array(self.right)
        node, at = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(at):
            at = at[feature[node[at]] >= 0]
            greater = x[at, feature[node[at]]] > cut[node[at]]
            node[at] = right[node[at]] - 1 + greater
        kind, there = np.full(len(x), len(self.patterns)), ~np.isnan(x)
        for i, p in enumerate(self.patterns):
            kind[(there == np.array(p)).all(axis=1)] = i
        return node * (len(self.patterns) + 1) + kind


@dataclass
class Boxes:
    """Parts with their number of rows, and for each feature how many have it and its least and greatest value."""

    part: np.ndarray
    rows: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """What the distance of each row to the rows of each part is at least; infinite where they share no feature.
        Features that rows of a part may lack add nothing, and the rest is scaled as if all were shared."""
        known = ~np.isnan(x)
        always, ever = self.n == self.rows[:, None], self.n > 0
        total = np.zeros((len(x), len(self.part)))
        for f in range(x.shape[1]):
            q = np.where(known[:, f], x[:, f], 0.0)[:, None]
            gap = np.maximum(np.maximum(self.low[:, f] - q, q - self.high[:, f]), 0.0)
            total += np.where(known[:, f, None] & always[:, f], gap, 0.0) ** 2
        shared = known.astype(float) @ ever.T.astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(shared > 0, total * x.shape[1] / shared * (1 - 1e-9), np.inf)

    def first(self, x: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
        """Whether each row first meets each part: the nearest ones that hold k rows with each of its missing cells."""
        order = np.argsort(bounds, axis=1, kind="stable")
        reached = np.isfinite(np.take_along_axis(bounds, order, axis=1))
        out = np.zeros(bounds.shape, bool)
        for f in range(x.shape[1]):
            lack = np.flatnonzero(np.isnan(x[:, f]))
            n = np.where(reached[lack], self.n[:, f][order[lack]], 0)
            r, c = np.nonzero((n > 0) & (n.cumsum(axis=1) - n < k))
            out[lack[r], order[lack[r], c]] = True
        return out


def _boxes(data: DataFrame, names: Sequence[str]) -> Boxes:
    """One aggregation; as many rows as there are parts."""
    measures = [x for c in names for x in (F.count(c).alias(f"n_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    got = data.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), *measures).orderBy("_part").toArrow()
    column = lambda kind: np.stack([got.column(f"{kind}_{c}").to_numpy().astype(float) for c in names], axis=1)
    return Boxes(got.column("_part").to_numpy(), got.column("_rows").to_numpy(), column("n"), column("lo"), column("hi"))


def _placed(tree: Tree, names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            part = tree.place(_values(b, names))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part), pa.array(np.arange(at, at + len(part)))], [*b.schema.names, "_part", "_s"])
            at += len(part)

    return run


def _openings(boxes: Boxes, names: Sequence[str], k: int, later: bool):
    """Incomplete rows with each part they meet: the first ones or, later, the others that their k-th distances reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 20) // max(1, len(boxes.part)))
        for whole in batches:
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                x = _values(b, names)
                bounds = boxes.bounds(x)
                meet = boxes.first(x, bounds, k)
                if later:
                    reach = np.nan_to_num(_values(b, [f"t_{c}" for c in names]), nan=np.inf)
                    wider = np.zeros(meet.shape, bool)
                    for f in range(len(names)):
                        lack = np.isnan(x[:, f])
                        wider[lack] |= (bounds[lack] <= reach[lack, f, None]) & (boxes.n[:, f] > 0)
                    meet = wider & ~meet & np.isfinite(bounds)
                r, c = np.nonzero(meet)
                own = b.select(["_q", *names]).take(pa.array(r))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(boxes.part[c])], [*own.schema.names, "_part"])

    return run


def _nearest(names: Sequence[str], k: int):
    """For each missing cell of a block of rows its k nearest of a block of a part: (_q, _cell, _d, _h, _value)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, ref, h, q = _values(left, names), _values(right, names), right.column("_h").to_numpy(), left.column("_q").to_numpy()
        there, known = ~np.isnan(ref), ~np.isnan(x)
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for pattern in np.unique(known, axis=0) if len(ref) else ():
            same, own = np.flatnonzero((known == pattern).all(axis=1)), np.flatnonzero(pattern)
            n = there[:, own].sum(axis=1)
            lacking = [(f, np.flatnonzero(there[:, f] & (n > 0))) for f in np.flatnonzero(~pattern)]
            for at in range(0, len(same), 64):
                some = same[at : at + 64]
                d = np.zeros((len(some), len(ref)))
                for f in own:
                    d += np.where(there[:, f], (ref[:, f] - x[some, f, None]) ** 2, 0.0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = np.where(n > 0, d * len(names) / n, np.inf)
                for f, rows in lacking:
                    if not len(rows):
                        continue
                    near, most = d[:, rows], min(k, len(rows))
                    r, c = np.nonzero(near <= np.partition(near, most - 1, axis=1)[:, most - 1 : most])
                    order = np.lexsort((ref[rows[c], f], h[rows[c]], near[r, c], r))
                    r, c = r[order], c[order]
                    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                    r, c = r[keep], c[keep]
                    for column, found in zip(out, (q[some[r]], np.full(len(r), f), near[r, c], h[rows[c]], ref[rows[c], f]), strict=True):
                        column.append(found)
        kinds = (np.int64, np.int32, float, np.int64, float)
        columns = (np.concatenate([np.zeros(0, t), *c]).astype(t) for c, t in zip(out, kinds, strict=True))
        return pa.table(dict(zip(("_q", "_cell", "_d", "_h", "_value"), columns, strict=True)))

    return run


def _met(pairs: DataFrame, data: DataFrame, boxes: Boxes, names: Sequence[str], k: int) -> DataFrame:
    """The nearest rows of each incomplete row in each part it meets. A part of many rows, or met by
    many, is cut into blocks on that side."""
    spark = data.sparkSession
    sizes = local_table(spark, [(int(p), -(-int(n) // ROWS)) for p, n in zip(boxes.part, boxes.rows, strict=True)], "_part long, _jn long")
    load = pairs.groupBy("_part").agg(F.ceil(F.count("*") / QUERIES).alias("_in")).join(F.broadcast(sizes), "_part")
    load = F.broadcast(stored(load, "part-blocks"))  # a row a part
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = pairs.join(load, "_part").select("_part", F.pmod(F.xxhash64("_q"), "_in").alias("_i"), every("_jn").alias("_j"), "_q", *names)
    right = data.join(load, "_part").select("_part", every("_in").alias("_i"), F.pmod(F.xxhash64("_h", "_s"), "_jn").alias("_j"), "_h", *names)
    block = ("_part", "_i", "_j")
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(_nearest(names, k), "_q long, _cell int, _d double, _h long, _value double")


def _best(near: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("_q", "_cell").orderBy("_d", "_h", "_value"))
    return near.withColumn("_place", place).where(F.col("_place") <= k)


def nearest_cells(rows: DataFrame, asked: DataFrame, names: Sequence[str], k: int, parts: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(_q, _cell, _d, _h, _value, _place): for every missing cell of every row of `asked` (_q and features)
    its k nearest of all `rows` (_h, by which ties go, and features); and (_part, _rows, _asked), the
    pairs of rows that were compared, by part."""
    spark = rows.sparkSession
    wanted = max(1, min(parts, -(-rows.count() // 512)))
    sample = rows.orderBy("_h", *names).limit(SAMPLE * wanted).select(*names).toArrow()
    some = asked.orderBy(F.xxhash64("_q"), "_q").limit(SAMPLE * wanted).select(*names).toArrow()
    tree = Tree.fit(_values(sample, names), _values(some, names), wanted)
    cells = ", ".join(f"{c} double" for c in names)
    data = stored(rows.select("_h", *names).mapInArrow(_placed(tree, names), f"_h long, {cells}, _part long, _s long"), "parts")
    boxes = _boxes(data, names)
    met = f"_q long, {cells}, _part long"
    first = stored(asked.select("_q", *names).mapInArrow(_openings(boxes, names, k, False), met), "first-parts")
    near = stored(_met(first, data, boxes, names, k), "near")
    reach = _best(near, k).where(F.col("_place") == k).groupBy("_q").agg(*(F.max(F.when(F.col("_cell") == i, F.col("_d"))).alias(f"t_{c}") for i, c in enumerate(names)))
    bounded = asked.select("_q", *names).join(reach, "_q", "left")
    later = stored(bounded.mapInArrow(_openings(boxes, names, k, True), met), "later-parts")
    best = _best(near.unionByName(_met(later, data, boxes, names, k)), k)
    sizes = local_table(spark, [(int(p), int(n)) for p, n in zip(boxes.part, boxes.rows, strict=True)], "_part long, _rows long")
    opened = first.unionByName(later).groupBy("_part").agg(F.count("*").alias("_asked")).join(F.broadcast(sizes), "_part")
    return best, opened


def incomplete(rows: DataFrame, features: Sequence[str], key: Sequence[str], seed: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows with a value, and the distinct ones that also lack one, under short names, as nearest_cells() takes them."""
    names = [f"f{i}" for i in range(len(features))]
    tie = F.conv(F.substring(key_hash(seed, key), 1, 15), 16, 10).cast("long")
    data = rows.select(tie.alias("_h"), *(F.col(c).alias(n) for c, n in zip(features, names, strict=True)))
    data = data.where(" or ".join(f"{n} is not null" for n in names))
    asked = data.where(" or ".join(f"{n} is null" for n in names)).select(*names).distinct()
    return data, stored(asked.withColumn("_q", F.monotonically_increasing_id()), "incomplete"), names


def knn_impute(df: DataFrame, features: Sequence[str], key: Sequence[str], k: int = 5, seed: str = "knn", parts: int = 4096) -> DataFrame:
    """Missing cells as the mean over the k nearest of all rows that have them.

    Distance: squared Euclidean over the features both rows have, scaled up to all; ties go by MD5 of seed
    and key, then by value. Exact at any size; parts: how many the rows are cut into at most. Infinite and
    NaN cells count as missing. No row shares a feature: the cell stays null, as in rows without any value.
    """
    rows = df.withColumns({c: finite(F.col(c).cast("double")) for c in features})
    data, asked, names = incomplete(rows, features, key, seed)
    if asked.isEmpty():
        return rows.select(*df.columns)
    best, _ = nearest_cells(data, asked, names, k, parts)
    mark = "_m"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    means = best.groupBy("_q").agg(*(F.avg(F.when(F.col("_cell") == i, F.col("_value"))).alias(f"{mark}{i}") for i in range(len(names))))
    means = asked.join(means, "_q").select(*(F.col(n).alias(f"{mark}q{i}") for i, n in enumerate(names)), *(f"{mark}{i}" for i in range(len(names))))
    same = [F.col(c).eqNullSafe(F.col(f"{mark}q{i}")) for i, c in enumerate(features)]
    place = {c: i for i, c in enumerate(features)}
    filled = rows.join(means, same, "left")
    return filled.select(*(F.coalesce(c, f"{mark}{place[c]}").alias(c) if c in place else F.col(c) for c in df.columns))
