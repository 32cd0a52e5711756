"""Tree ensembles grown level by level, and what each feature adds to their scores.

A level is one aggregation over the rows: every task routes its batches through the trees so far and
adds up what the candidate cuts of all open nodes need; Spark sums that over the tasks and picks each
node's cut, and the driver gets a row for each node, so it holds the model and nothing of the data.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.blocks import blocks, opened
from flowlens.functions.ranks import quantiles
from flowlens.sources.stage import stored

CELLS = 1 << 22  # sums that a task holds; levels with more nodes take several aggregations


@dataclass
class Tree:
    """Nodes as lists: rows with feature <= cut go to node `left`, others to the next one; feature -1 is a
    leaf. value: k outputs, or one if the tree is of class `target`. cover: the weight of a node's rows."""

    target: int = -1
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[list[float]] = field(default_factory=lambda: [[0.0]])
    cover: list[float] = field(default_factory=lambda: [0.0])

    def grow(self, node: int, feature: int, cut: float, values: Sequence[list[float]], covers: Sequence[float]) -> int:
        """Two children of a leaf; returns the left one."""
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, at
        for v, c in zip(values, covers, strict=True):
            for own, x in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.value, list(v)), (self.cover, float(c))):
                own.append(x)
        return at

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row; a NaN goes right."""
        return _Router(self).leaves(np.ascontiguousarray(x.T))


class _Router:
    """A tree as arrays. A leaf has itself as both its children, so all rows take as many steps as the tree is deep."""

    def __init__(self, tree: Tree) -> None:
        feature, left = np.array(tree.feature), np.array(tree.left)
        inner, own = feature >= 0, np.arange(len(feature))
        self.feature, self.cut = np.where(inner, feature, 0), np.array(tree.cut, dtype=float)
        self.children = np.stack([np.where(inner, left, own), np.where(inner, left + 1, own)], axis=1).ravel()
        depth = [0] * len(own)
        for at in np.flatnonzero(inner).tolist():  # children stand behind their node
            depth[tree.left[at]] = depth[tree.left[at] + 1] = depth[at] + 1
        self.depth = max(depth)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row; a NaN goes right. x: a line a feature."""
        n = x.shape[1]
        at, rows, cells, line = np.zeros(n, dtype=np.int64), np.arange(n), x.ravel(), self.feature * n
        for _ in range(self.depth):
            go = np.less_equal(cells.take(line.take(at) + rows), self.cut.take(at))
            at *= 2
            at += 1
            at -= go
            at = self.children.take(at)
        return at


@dataclass
class Ensemble:
    """kind "mean": probabilities are the mean of the trees' values; "softmax": of the sums of margins of the
    classes `present` (default: all)."""

    features: list[str]
    k: int
    kind: str
    trees: list[Tree] = field(default_factory=list)
    present: list[int] | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.k))
        for t in self.trees:
            value = np.array(t.value)[t.leaves(x)]
            if t.target < 0:
                out += value
            else:
                out[:, t.target] += value[:, 0]
        return out / max(1, len(self.trees)) if self.kind == "mean" else out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        s = self.scores(x)
        if self.kind == "softmax":
            if self.present is not None:
                s[:, [c for c in range(self.k) if c not in self.present]] = -np.inf
            s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / np.maximum(s.sum(axis=1, keepdims=True), 1e-300)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with proba, array<double> of k."""

        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series(list(self.probabilities(np.stack([c.to_numpy(float) for c in columns], axis=1))))

        score = F.pandas_udf(run, T.ArrayType(T.DoubleType()))
        return df.withColumn("proba", score(*(F.col(f"`{f}`").cast("double") for f in self.features)))

    def importance(self) -> list[float]:
        """For each feature the cover of the nodes that it splits."""
        out = [0.0] * len(self.features)
        for t in self.trees:
            for f, c in zip(t.feature, t.cover, strict=True):
                if f >= 0:
                    out[f] += c
        return out

    def as_dict(self) -> dict:
        return {"features": self.features, "k": self.k, "kind": self.kind, "trees": [vars(t) for t in self.trees], "present": self.present}

    @staticmethod
    def of_dict(d: dict) -> Ensemble:
        return Ensemble(d["features"], d["k"], d["kind"], [Tree(**t) for t in d["trees"]], d["present"])


def _table(df: DataFrame, features: Sequence[str], code: str, weight: str | None) -> DataFrame:
    own = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    return df.where(F.col(code).isNotNull()).select(*(F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)), F.col(code).cast("int").alias("y"), own.alias("w"))


def _arrays(b: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (null as NaN), classes and weights of a batch."""
    x = [b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)]
    return np.stack(x, axis=1) if d else np.zeros((b.num_rows, 0)), b.column(d).to_numpy(zero_copy_only=False).astype(np.int64), b.column(d + 1).to_numpy(zero_copy_only=False)


def digest(*parts: object) -> str:
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


@dataclass
class _Node:
    """An open node: its tree, number, path (1 the root, then 2p and 2p + 1), box and tries."""

    tree: int
    node: int
    path: int
    low: list[float]
    high: list[float]
    tries: list[tuple[int, float]] = field(default_factory=list)


def extra_trees(df: DataFrame, features: Sequence[str], code: str, k: int, weight: str | None = None, trees: int = 100, depth: int = 14, least: float = 2.0, tries: int | None = None, seed: str = "extra") -> Ensemble:
    """Extremely randomised trees: every node draws `tries` features (default: the root of their number) and
    one cut each, and takes that of the largest fall in Gini impurity.

    Draws are hashes of seed, tree, path and feature, and a cut lies evenly between the bounds that the cuts
    above leave of the feature's range; so a tree depends neither on partitions nor on reruns. A node
    closes with one class, less than `least` weight, at `depth`, or where no draw parts its rows.
    """
    features = list(features)
    rows, d = _table(df, features, code, weight), len(features)
    ends = rows.agg(*(f(f"x{i}") for i in range(d) for f in (F.min, F.max)), F.count("*")).first()
    low, high = [float(ends[2 * i] or 0.0) for i in range(d)], [float(ends[2 * i + 1] or 0.0) for i in range(d)]
    m = tries or max(1, round(math.sqrt(d)))
    out = Ensemble(features, k, "mean", [Tree(value=[[0.0] * k]) for _ in range(trees)])
    open_ = [_Node(t, 0, 1, low, high) for t in range(trees)]
    kept = blocks(rows, d, ends[-1])
    try:
        for level in range(depth):
            for n in open_:
                names = sorted((i for i in range(d) if n.low[i] < n.high[i]), key=lambda i: digest(seed, n.tree, n.path, features[i]))
                n.tries = [(i, n.low[i] + int(digest(seed, n.tree, n.path, features[i], "cut")[:8], 16) / 2**32 * (n.high[i] - n.low[i])) for i in names[:m]]
            open_ = [n for n in open_ if n.tries]
            step = max(1, CELLS // (m * 2 * k))
            below = []
            for a in range(0, len(open_), step):
                part = open_[a : a + step]
                for f, j, left, right in _gini_cuts(kept, out, part, m, d):
                    n = part[f]
                    tree, (i, cut) = out.trees[n.tree], n.tries[j]
                    sums = [sum(left), sum(right)]
                    if level == 0:
                        both = [x + y for x, y in zip(left, right, strict=True)]
                        tree.value[0], tree.cover[0] = [x / sum(both) for x in both], sum(both)
                    if min(sums) <= 0:
                        continue
                    child = tree.grow(n.node, i, cut, [[x / s for x in c] for c, s in zip((left, right), sums, strict=True)], sums)
                    for side, (counts, total) in enumerate(zip((left, right), sums, strict=True)):
                        if total >= least and max(counts) < total:
                            lo, hi = list(n.low), list(n.high)
                            (lo if side else hi)[i] = cut
                            below.append(_Node(n.tree, child + side, 2 * n.path + side, lo, hi))
            open_ = below
            if not open_:
                break
    finally:
        kept.unpersist()
    return out


def _gini_cuts(rows: DataFrame, model: Ensemble, nodes: list[_Node], m: int, d: int) -> list[tuple[int, int, list[float], list[float]]]:
    """(node, try, weights by class on the left, on the right) of each node's best try."""
    k, trees = model.k, model.trees
    by: dict[int, list[int]] = {}
    for f, n in enumerate(nodes):
        by.setdefault(n.tree, []).append(f)
    feature, cut = np.full((len(nodes), m), -1), np.zeros((len(nodes), m))
    for f, n in enumerate(nodes):
        for j, (i, c) in enumerate(n.tries):
            feature[f, j], cut[f, j] = i, c
    number = np.array([n.node for n in nodes])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(nodes), m, 2 * k))
        ways = []
        for t, own in by.items():
            slot = np.full(len(trees[t].feature), -1)
            slot[number[own]] = np.arange(len(own))
            ways.append((_Router(trees[t]), slot, own, np.zeros((m, len(own) * 2 * k))))
        for b in batches:
            for x, y, w in opened(b, d):
                cells, n = x.ravel(), len(y)
                for router, slot, own, sums in ways:
                    f = slot.take(router.leaves(x))
                    at = np.flatnonzero(f >= 0)
                    f, first, weight = f.take(at), y.take(at), w.take(at)
                    first = first + f * (2 * k)
                    for j in range(m):
                        i, c = feature[own, j], cut[own, j]
                        if (i < 0).all():
                            continue
                        right = ~np.less_equal(cells.take((np.maximum(i, 0) * n).take(f) + at), c.take(f))
                        sums[j] += np.bincount(first + right * k, weights=weight, minlength=len(sums[j]))
        for _, _, own, sums in ways:
            total[own] = sums.reshape(m, len(own), 2 * k).swapaxes(0, 1)
        total[feature < 0] = 0
        total = total.ravel()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "w"])

    cells = rows.mapInArrow(count, "cell long, w double").groupBy("cell").agg(F.sum("w").alias("w"))
    cells = cells.select((F.floor(F.col("cell") / (2 * k * m))).alias("f"), (F.floor(F.col("cell") / (2 * k)) % m).alias("j"), (F.floor(F.col("cell") / k) % 2).alias("s"), (F.col("cell") % k).alias("c"), "w")
    side = lambda s: F.array(*(F.coalesce(F.sum(F.when((F.col("s") == s) & (F.col("c") == c), F.col("w"))), F.lit(0.0)) for c in range(k)))
    each = cells.groupBy("f", "j").agg(side(0).alias("a"), side(1).alias("b"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    pure = lambda a: F.coalesce(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v), add(a)), F.lit(0.0))
    both = F.zip_with("a", "b", lambda x, y: x + y)
    gain = (pure(F.col("a")) + pure(F.col("b")) - pure(both)) / add(both)
    parts = (add(F.col("a")) > 0) & (add(F.col("b")) > 0)
    best = F.max_by(F.struct("j", "a", "b"), F.struct(parts, F.round(gain, 9), -F.col("j")))
    return [(int(r["f"]), int(r["t"]["j"]), r["t"]["a"], r["t"]["b"]) for r in each.groupBy("f").agg(best.alias("t")).collect()]


def softmax_boosting(
    df: DataFrame, features: Sequence[str], code: str, k: int, weight: str | None = None, held: str | None = None, rounds: int = 20, depth: int = 4, rate: float = 0.3, bins: int = 32, l2: float = 1.0, least: float = 1e-3, patience: int = 5,
) -> Ensemble:
    """Gradient boosting of the multiclass log loss: each round grows a tree for every class on the same
    probabilities, level by level, from sums of gradients and curvatures by (class, node, feature, bin).

    Cuts are exact quantiles of the training rows, `bins` - 1 at most a feature. Rows matter by their bins and class
    alone, so those that share them are summed once (_binned()), and levels read these sums. A cut takes the largest gain
    sum(g)^2 / (sum(h) + l2); both sides need `least` curvature. held: a boolean column; its rows are left
    out, and rounds end once their log loss has not fallen for `patience` of them; the best number stays.
    """
    features, d = list(features), len(features)
    train = df.where(~F.coalesce(F.col(held), F.lit(False))) if held else df
    rows = _table(train, features, code, weight)
    classes = sorted(r[0] for r in rows.select("y").distinct().collect())
    found = quantiles(rows, {f"x{i}": [b / bins for b in range(1, bins)] for i in range(d)})
    cuts = [sorted({found[f"x{i}", b / bins] for b in range(1, bins)} - {None}) for i in range(d)]
    rows = _binned(rows, cuts)
    # grown on numbers of bins; `real` has the cuts themselves
    model, best = Ensemble(features, k, "softmax", present=classes), (math.inf, 0)
    real = lambda: Ensemble(features, k, "softmax", [replace(t, cut=[cuts[i][int(c)] if i >= 0 else c for i, c in zip(t.feature, t.cut, strict=True)]) for t in model.trees], classes)
    for _ in range(rounds):
        grown = [Tree(target=c) for c in classes]
        open_ = [(t, 0) for t in range(len(grown))]
        for level in range(depth):
            split = []
            for f, i, b, (g, h, n), (gl, hl, nl) in _gradient_cuts(rows, model, grown, open_, cuts, least, l2):
                t, node = open_[f]
                if level == 0:
                    grown[t].value[0], grown[t].cover[0] = [-rate * g / (h + l2)], n
                if i is None:
                    continue
                sides = ((gl, hl), (g - gl, h - hl))
                child = grown[t].grow(node, i, float(b), [[-rate * a / (c + l2)] for a, c in sides], (nl, n - nl))
                split += [(t, child), (t, child + 1)]
            open_ = split
            if not open_:
                break
        model.trees += grown
        if held:
            rest = real().transform(df.where(F.col(held) & F.col(code).isNotNull()))
            p = F.greatest(F.element_at("proba", F.col(code).cast("int") + 1), F.lit(1e-15))
            loss = rest.agg(F.avg(-F.ln(p))).first()[0]
            best = min(best, (math.inf if loss is None else loss, len(model.trees)))
            if len(model.trees) - best[1] >= patience * len(classes):
                break
    if held and math.isfinite(best[0]):
        model.trees = model.trees[: best[1]]
    return real()


def _binned(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """rows of _table() with the numbers of their bins in place of the features, one for all rows of equal bins and
    class with the sum of their weights; stored, as every level reads it. A null or NaN is in the last bin."""
    d = len(cuts)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, w = _arrays(b, d)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.searchsorted(np.array(c), x[:, i], side="left").astype(np.int32)) for i, c in enumerate(cuts)), pa.array(y.astype(np.int32)), pa.array(w)], names=names)

    names = [*(f"x{i}" for i in range(d)), "y", "w"]
    numbered = rows.mapInArrow(number, ", ".join([*(f"{n} int" for n in names[:-1]), "w double"]))
    return stored(numbered.groupBy(*names[:-1]).agg(F.sum("w").alias("w")), "binned")


def _gradient_cuts(rows: DataFrame, model: Ensemble, grown: list[Tree], nodes: list[tuple[int, int]], cuts: list[list[float]], least: float, l2: float) -> Iterator[tuple]:
    """(node, feature or None, bin, sums of the node, sums of the left side), sums: gradient, curvature, weight; rows are
    those of _binned()."""
    d, wide = len(cuts), max([len(c) for c in cuts], default=0) + 1
    by: dict[int, list[int]] = {}
    for f, (t, _) in enumerate(nodes):
        by.setdefault(t, []).append(f)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(nodes) * d * wide))
        for b in batches:
            x, y, w = _arrays(b, d)
            p = model.probabilities(x)
            bins = x.astype(np.int64).T
            for t, own in by.items():
                slot = np.full(len(grown[t].feature), -1)
                slot[[nodes[f][1] for f in own]] = own
                f = slot[grown[t].leaves(x)]
                at = np.flatnonzero(f >= 0)
                q = p[at, grown[t].target]
                sums = (w[at] * (q - (y[at] == grown[t].target)), w[at] * q * (1 - q), w[at])
                for i in range(d):
                    cell = (f[at] * d + i) * wide + bins[i][at]
                    for s in range(3):
                        total[s] += np.bincount(cell, weights=sums[s], minlength=total.shape[1])
        at = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[s][at]) for s in range(3))], names=["cell", "g", "h", "n"])

    cells = rows.mapInArrow(count, "cell long, g double, h double, n double").groupBy("cell").agg(*(F.sum(c).alias(c) for c in "ghn"))
    cells = cells.select(F.floor(F.col("cell") / (wide * d)).alias("f"), (F.floor(F.col("cell") / wide) % d).alias("i"), (F.col("cell") % wide).alias("b"), "g", "h", "n")
    upto, whole = Window.partitionBy("f", "i").orderBy("b"), Window.partitionBy("f", "i")  # `bins` rows at most
    sums = cells.withColumns({**{f"{c}l": F.sum(c).over(upto) for c in "ghn"}, **{f"{c}t": F.sum(c).over(whole) for c in "ghn"}})
    part = lambda g, h: g * g / (h + l2)
    gr, hr = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    gain = F.round(part(F.col("gl"), F.col("hl")) + part(gr, hr) - part(F.col("gt"), F.col("ht")), 9)
    fine = (F.col("nl") < F.col("nt")) & (F.col("hl") >= least) & (hr >= least) & (gain > 0)
    sums = sums.withColumn("o", F.struct(fine.alias("fine"), F.when(fine, gain).otherwise(0.0).alias("gain"), -F.col("i"), -F.col("b")))
    for r in sums.groupBy("f").agg(F.max_by(F.struct("o.fine", "i", "b", "gt", "ht", "nt", "gl", "hl", "nl"), "o").alias("t")).collect():
        t = r["t"]
        yield int(r["f"]), int(t["i"]) if t["fine"] else None, int(t["b"]), (t["gt"], t["ht"], t["nt"]), (t["gl"], t["hl"], t["nl"])


def of_spark(model, features: Sequence[str]) -> Ensemble:
    """A fitted Spark ML tree or forest classifier as an Ensemble; its cuts must be of ordered features."""
    out = Ensemble(list(features), model.numClasses, "mean")
    for one in getattr(model, "trees", None) or [model]:
        tree = Tree(value=[[]])
        waiting = [(one._call_java("rootNode"), 0)]
        while waiting:
            node, at = waiting.pop()
            stats = list(node.impurityStats().stats())
            total = sum(stats)
            tree.value[at], tree.cover[at] = [s / total for s in stats], total
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                child = tree.grow(at, split.featureIndex(), split.threshold(), ([], []), (0.0, 0.0))
                waiting += [(node.leftChild(), child), (node.rightChild(), child + 1)]
        out.trees.append(tree)
    return out


def _paths(tree: Tree) -> Iterator[tuple[int, dict[int, tuple[list[tuple[float, bool]], float]]]]:
    """Each leaf with the features on its path: their conditions (cut, whether left) and the product of the
    shares of cover that the path takes at their nodes."""
    waiting: list[tuple[int, dict]] = [(0, {})]
    while waiting:
        at, path = waiting.pop()
        i = tree.feature[at]
        if i < 0:
            yield at, path
            continue
        for side in (0, 1):
            child = tree.left[at] + side
            had, share = path.get(i, ([], 1.0))
            waiting.append((child, path | {i: ([*had, (tree.cut[at], side == 0)], share * tree.cover[child] / tree.cover[at])}))


def attributions(model: Ensemble, x: np.ndarray, target: int) -> tuple[np.ndarray, float]:
    """(rows, features) of Shapley values of the class's score, and its expected score; both add up to it.

    Features outside a subset follow both branches by cover. For a leaf, the sum over all subsets of the
    features on its path is that over the coefficients of a polynomial with a factor for each of them,
    z + o t: o whether the row keeps to the path there, z the share of cover that does.
    """
    out, expected = np.zeros((len(x), len(model.features))), 0.0
    scale = 1 / max(1, len(model.trees)) if model.kind == "mean" else 1.0
    for tree in model.trees:
        if tree.target not in (-1, target):
            continue
        for leaf, path in _paths(tree):
            value = scale * tree.value[leaf][target if tree.target < 0 else 0]
            names = list(path)
            u = len(names)
            z = [path[i][1] for i in names]
            expected += value * math.prod(z)
            keeps = [np.all([(x[:, i] <= c) == left for c, left in path[i][0]], axis=0).astype(float) for i in names]
            weight = [math.factorial(s) * math.factorial(u - 1 - s) / math.factorial(u) for s in range(u)]
            for j, i in enumerate(names):
                poly = [np.ones(len(x))]
                for n in range(u):
                    if n != j:
                        poly = [(poly[s] * z[n] if s < len(poly) else 0.0) + (poly[s - 1] * keeps[n] if s else 0.0) for s in range(len(poly) + 1)]
                out[:, i] += value * (keeps[j] - z[j]) * sum(w * p for w, p in zip(weight, poly, strict=True))
    return out, expected


def tree_contributions(df: DataFrame, model: Ensemble, key: Sequence[str], target: int) -> DataFrame:
    """(key, one column a feature, expected, score): what each feature adds to a row's score of a class.

    The score is a probability for "mean", a margin for "softmax". An error if a row's contributions and
    the expected score don't add up to its score within 1e-6.
    """
    d = len(model.features)
    expected = attributions(model, np.zeros((0, d)), target)[1]
    schema = T.StructType([df.schema[k] for k in key] + [T.StructField(c, T.DoubleType()) for c in (*model.features, "expected", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(len(key) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)], axis=1)
            parts, score = attributions(model, x, target)[0], model.scores(x)[:, target]
            if len(x) and np.abs(parts.sum(axis=1) + expected - score).max() > 1e-6:
                raise ValueError("contributions don't add up to the score")
            yield pa.RecordBatch.from_arrays([*b.columns[: len(key)], *(pa.array(c) for c in parts.T), pa.array(np.full(len(x), expected)), pa.array(score)], names=schema.names)

    return df.select(*key, *(F.col(f"`{f}`").cast("double") for f in model.features)).mapInArrow(run, schema)
