"""Class rebalancing of training rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.local import local_table
from flowlens.functions.portable import class_rank, numbered, rounded
from flowlens.operators.sample import class_counts
from flowlens.sources.stage import stored

#: Rows of a block, about; pairs of blocks are compared.
BLOCK = 8192
#: Zones that the parts of a class are packed into, until a zone has ZONE blocks of rows; a row is sent to a zone once.
ZONES, ZONE = 12, 8
#: Parts of a class in the index at most, and its rows for each part, about.
PARTS, PART_ROWS = 256, 1024


def targets(counts: dict[str, int], ratio: float = 0.25, expansion: float = 20.0, least: int = 0) -> dict[str, tuple[int, bool]]:
    """class -> (rows wanted, whether the expansion capped them)."""
    most = max(counts.values(), default=0)
    out = {}
    for c, n in counts.items():
        want, cap = max(math.ceil(ratio * most), least), math.floor(n * expansion)
        out[c] = (max(n, min(want, cap)), want > cap)
    return out


def target_table(df: DataFrame, label: str, ratio: float = 0.25, expansion: float = 20.0, least: int = 0) -> DataFrame:
    counts = class_counts(df, label)
    rows = [(c, counts[c], t, capped) for c, (t, capped) in targets(counts, ratio, expansion, least).items()]
    return local_table(df.sparkSession, rows, "class string, n long, target long, capped boolean")


def oversample(df: DataFrame, label: str, key: Sequence[str], wanted: dict[str, int], seed: str) -> DataFrame:
    """df with rows of small classes repeated to their target: whole repeats for all, one more for the
    first in hash order; `copy` is 0 for the row itself."""
    counts = class_counts(df, label)
    more = {c: wanted[c] for c in wanted if c in counts and wanted[c] > counts[c]}
    if not more:
        return df.withColumn("copy", F.lit(0))
    plan = [(c, t // counts[c], t % counts[c]) for c, t in more.items()]
    table = local_table(df.sparkSession, plan, f"_class {dict(df.dtypes)[label]}, _times long, _rest long")
    small = class_rank(df.where(F.col(label).isin(*more)), label, key, seed, "_rank").join(F.broadcast(table), F.col(label) == F.col("_class"))
    times = F.col("_times") + F.when(F.col("_rank") <= F.col("_rest"), 1).otherwise(0)
    grown = small.withColumn("copy", F.explode(F.sequence(F.lit(0), (times - 1).cast("int")))).select(*df.columns, "copy")
    return df.where(~F.col(label).isin(*more) | F.col(label).isNull()).withColumn("copy", F.lit(0)).unionByName(grown)


def _vectors(table: pa.Table) -> np.ndarray:
    v = table.column("_v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _nearest(k: int):
    """The k nearest rows of a block to each row of another, by distance rounded to 6 digits, then key."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"_k": left.column("_k").slice(0, 0), "_n": left.column("_k").slice(0, 0), "_d": pa.array([], pa.float64())})
        right = right.take(pc.sort_indices(right.column("_k")))
        q, d = _vectors(left), _vectors(right)
        # a row is no neighbour of itself, and a key lies in one block
        codes = {x: n for n, x in enumerate(dict.fromkeys(right.column("_k").to_pylist()))}
        own_q, own_d = (np.array([codes.get(x, -1) for x in t.column("_k").to_pylist()]) for t in (left, right))
        norms = (d * d).sum(axis=1)
        who, near, far = [], [], []
        for at in range(0, len(q), 128):
            x = q[at : at + 128]
            length = (x * x).sum(axis=1)
            squares = length[:, None] + norms[None, :] - 2 * (x @ d.T)
            squares[own_q[at : at + 128, None] == own_d[None, :]] = np.inf
            top = np.partition(squares, min(k, len(d)) - 1, axis=1)[:, min(k, len(d)) - 1]
            # room for the error of the product and for ties once rounded
            slack = 1e-11 * (length + norms.max()) + 4e-6 * np.sqrt(np.maximum(top, 0)) + 1e-11
            r, c = np.nonzero((squares <= (top + slack)[:, None]) & np.isfinite(squares))
            exact = np.concatenate([np.zeros(0), *(np.sqrt(((x[r[n : n + 65536]] - d[c[n : n + 65536]]) ** 2).sum(axis=1)) for n in range(0, len(r), 65536))])
            order = np.lexsort((c, np.round(exact, 6), r))
            r, c, exact = r[order], c[order], exact[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < k
            who.append(r[keep] + at)
            near.append(c[keep])
            far.append(exact[keep])
        return pa.table({"_k": left.column("_k").take(pa.array(np.concatenate(who))), "_n": right.column("_k").take(pa.array(np.concatenate(near))), "_d": pa.array(np.concatenate(far))})

    return run


def _pivots(rows: DataFrame, sizes: DataFrame) -> dict[object, np.ndarray]:
    """Class -> vectors that its rows gather around, by hash order; PARTS a class at most."""
    share = F.pmod(F.xxhash64("_k", F.lit("pivot")), F.lit(1 << 31)) / F.lit(float(1 << 31))
    some = rows.join(F.broadcast(sizes.where("_parts > 1")), F.col("_c") == F.col("_own")).withColumn("_h", share)
    some = some.where(F.col("_h") < (2 * F.col("_parts") + 8) / F.col("_n"))
    place = F.row_number().over(Window.partitionBy("_c").orderBy("_h", "_k"))
    out: dict[object, list] = {}
    for r in some.withColumn("_at", place).where(F.col("_at") <= F.col("_parts")).select("_c", "_v").collect():
        out.setdefault(r["_c"], []).append(r["_v"])
    return {c: np.array(v, dtype=float) for c, v in out.items()}


def _away(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, exact to some 1e-12."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _bounds(d: np.ndarray, own: np.ndarray, parts: Sequence[int], radii: dict[int, tuple[float, float]]) -> np.ndarray:
    """(row, part): what the distance from a row to any row of the part can't fall under. d: the rows' distances to the
    parts' pivots; own: to the pivots of their own parts."""
    low, high = (np.array([radii[p][n] for p in parts]) for n in (0, 1))
    return np.maximum.reduce([d - high, low - d, (d - own[:, None]) / 2])


def _closer(k: int, pivots, radii: dict):
    """The k nearest rows of a zone to each row that asks it, as far as they reach the k-th distance that the row has.

    A part is compared with the rows whose bound reaches it alone, and what they find lowers their k-th distance for
    the next part. Of equal vectors of a zone the first k by key are enough.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"_k": left.column("_k").slice(0, 0), "_n": left.column("_k").slice(0, 0), "_d": pa.array([], pa.float64())})
        right = right.take(pc.sort_indices(right.column("_k")))
        q, d = _vectors(left), np.ascontiguousarray(_vectors(right))
        own, far, top = (left.column(c).to_numpy() for c in ("_p", "_r", "_t"))
        part, top = right.column("_p").to_numpy(), top.copy()
        c = left.column("_c")[0].as_py()
        same = np.unique(d.view(np.dtype((np.void, d.itemsize * d.shape[1]))).ravel(), return_inverse=True)[1].ravel()
        order = np.argsort(same, kind="stable")
        rows = np.sort(order[np.arange(len(d)) - np.searchsorted(same[order], same[order]) < k])
        there = np.unique(part)
        bound = _bounds(_away(q, pivots.value[c][there]), far, there, radii[c])
        near, what = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
        length = (q * q).sum(axis=1)
        wide = np.concatenate([q, np.ones((len(q), 1))], axis=1)
        for n, p in enumerate(there):
            at = rows[part[rows] == p]
            asks = np.flatnonzero((own != p) & (bound[:, n] <= top + 2e-6))  # a row has met its own part; room for rounded distances
            if not len(asks):
                continue
            norms = (d[at] * d[at]).sum(axis=1)
            turned = np.concatenate([-2 * d[at], norms[:, None]], axis=1).T
            step = max(16, (1 << 20) // len(at))
            for a in range(0, len(asks), step):
                own_rows = asks[a : a + step]
                limit = (top[own_rows] + 2e-6) ** 2 + 1e-11 * (length[own_rows] + norms.max() + 1) - length[own_rows]
                hit = np.flatnonzero((wide[own_rows] @ turned <= limit[:, None]).ravel())
                if not len(hit):
                    continue
                r, h = own_rows[hit // len(at)], at[hit % len(at)]
                exact = np.concatenate([np.sqrt(((q[r[m : m + 65536]] - d[h[m : m + 65536]]) ** 2).sum(axis=1)) for m in range(0, len(r), 65536)])
                some = np.unique(r)
                r, exact, h = np.concatenate([r, np.repeat(some, k)]), np.concatenate([exact, near[some].ravel()]), np.concatenate([h, what[some].ravel()])
                order = np.lexsort((h, np.round(exact, 6), r))
                r, exact, h = r[order], exact[order], h[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                keep = place < k
                near[r[keep], place[keep]], what[r[keep], place[keep]] = exact[keep], h[keep]
                top[some] = np.minimum(top[some], near[some, k - 1])
        who, place = np.nonzero(what >= 0)
        return pa.table({"_k": left.column("_k").take(pa.array(who)), "_n": right.column("_k").take(pa.array(what[who, place])), "_d": pa.array(near[who, place])})

    return run


def _zones(stats: list, block: int) -> dict[tuple[object, int], tuple[int, int]]:
    """(class, part) -> (zone, slices): parts packed into zones of some 1/ZONES of the class, of ZONE blocks at most; a
    part that is larger is a zone of several slices."""
    sizes: dict[object, list[tuple[int, int]]] = {}
    for r in sorted(stats, key=lambda r: r["_part"]):
        sizes.setdefault(r["_own"], []).append((r["_part"], r["_rows"]))
    out = {}
    for c, parts in sizes.items():
        most = min(ZONE * block, -(-sum(n for _, n in parts) // ZONES))
        zone, held = 0, 0
        for p, n in parts:
            if held and held + n > most:
                zone, held = zone + 1, 0
            held += n
            out[c, p] = (zone, max(1, -(-n // (ZONE * block))))
    return out


def _by_class(b: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
    labels = b.column(b.schema.get_field_index("_c")).to_pylist()
    places: dict[object, list[int]] = {}
    for n, c in enumerate(labels):
        places.setdefault(c, []).append(n)
    return ((c, np.array(at)) for c, at in places.items())


def neighbours(df: DataFrame, key: str, label: str, vector: str, k: int = 5, classes: Sequence[str | int] | None = None, block: int = BLOCK, part_rows: int = PART_ROWS, work: dict[str, int] | None = None) -> DataFrame:
    """(key, neighbour, distance, place): the k nearest rows of the same class, itself excluded.

    vector: array<double>, finite. Distances are rounded to 6 digits, ties go by key; k shrinks to the
    class. Exact at any size, by a metric index: each row belongs to the part of its nearest pivot (PARTS
    a class at most), and finds the k nearest of its part first. The k-th distance then bounds the other
    parts it meets: by the triangle inequality no row of a part is nearer than the part's radii leave, nor
    than half the difference of the two pivots' distances. Parts are packed into zones (_zones()), and a row
    is sent once to each zone with a part whose bound reaches the k-th distance; there it meets these parts
    alone (_closer()). So a row and its copies for others are sent ZONES times each, about, while a class has
    up to ZONES * ZONE * block rows. Where vectors have no clusters, few parts are left out and the comparisons
    grow with the square of a class. The driver holds the pivots, and a row of radii a part. work: gets the
    numbers of pairs of row and part, and of those whose bound reached when they were asked.
    """
    spark = df.sparkSession
    rows = df if classes is None else df.where(F.col(label).isin(*classes))
    rows = rows.select(F.col(key).alias("_k"), F.col(label).alias("_c"), F.col(vector).cast("array<double>").alias("_v")).where(F.col("_c").isNotNull())
    kinds = dict(rows.dtypes)
    count = F.count("*")
    sizes = stored(rows.groupBy(F.col("_c").alias("_own")).agg(count.alias("_n"), F.least(F.lit(PARTS), F.ceil(count / part_rows)).alias("_parts")), "neighbour-sizes")
    pivots = spark.sparkContext.broadcast(_pivots(rows, sizes))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            x, part, far = _vectors(pa.table(b)), np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for c, at in _by_class(b):
                if c in pivots.value:
                    d = _away(x[at], pivots.value[c])
                    part[at] = d.argmin(axis=1)
                    far[at] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part), pa.array(far)], names=[*b.schema.names, "_p", "_r"])

    parts = stored(rows.mapInArrow(assign, f"_k {kinds['_k']}, _c {kinds['_c']}, _v array<double>, _p int, _r double"), "neighbour-parts")
    blocks = F.ceil(F.count("*") / block).cast("int")
    stats = stored(parts.groupBy(F.col("_c").alias("_own"), F.col("_p").alias("_part")).agg(F.count("*").alias("_rows"), blocks.alias("_blocks"), F.min("_r").alias("_low"), F.max("_r").alias("_high")), "neighbour-radii")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda n: F.pmod(F.xxhash64("_k"), F.col(n)).cast("int")
    again = lambda c: F.col(c).alias(c)
    by, out = ["_c", "_p", "_i", "_j"], f"_k {kinds['_k']}, _n {kinds['_k']}, _d double"
    met = lambda a, b: a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(_nearest(k), out).withColumn("_d", rounded(F.col("_d")))
    in_part = lambda t, p="_p": (t["_c"] == F.col("_own")) & (F.col(p) == F.col("_part"))
    cut = parts.join(F.broadcast(stats), in_part(parts)).select("_c", "_p", "_k", "_v", "_blocks", at("_blocks").alias("_b"))
    left = cut.select("_c", "_p", F.col("_b").alias("_i"), each("_blocks").alias("_j"), "_k", "_v")
    right = cut.select(again("_c"), again("_p"), each("_blocks").alias("_i"), F.col("_b").alias("_j"), again("_k"), again("_v"))
    place = F.row_number().over(Window.partitionBy("_k").orderBy("_d", "_n"))
    near = met(left, right).withColumn("place", place).where(F.col("place") <= k)
    if pivots.value:
        near = stored(near, "neighbour-own")
        known = stats.collect()  # a row a part
        radii: dict[object, dict[int, tuple[float, float]]] = {}
        for r in known:
            radii.setdefault(r["_own"], {})[r["_part"]] = (r["_low"], r["_high"])
        zones = _zones(known, block)
        kth = near.groupBy("_k").agg(F.when(F.count("*") >= k, F.max("_d")).otherwise(F.lit(float("inf"))).alias("_t"))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows with the zones of every other part that may hold a row as near as the k-th, and how many parts these are."""
            for b in (b for b in batches if b.num_rows):
                x, own, far = _vectors(pa.table(b)), *(b.column(b.schema.get_field_index(c)).to_numpy() for c in ("_p", "_r"))
                top = b.column(b.schema.get_field_index("_t")).to_numpy(zero_copy_only=False)
                asked, opened = [[]] * len(x), np.zeros(len(x), np.int32)
                for c, rows_ in _by_class(b):
                    if c not in pivots.value:
                        continue
                    names = np.array(sorted(radii[c]))
                    hit = _bounds(_away(x[rows_], pivots.value[c][names]), far[rows_], names, radii[c]) <= top[rows_, None] + 2e-6  # room for rounded distances
                    hit &= own[rows_, None] != names[None, :]
                    opened[rows_] = hit.sum(axis=1)
                    zone = np.array([zones[c, p][0] for p in names.tolist()])
                    first = np.flatnonzero(np.diff(zone, prepend=-1))  # parts of a zone follow each other
                    which = np.logical_or.reduceat(hit, first, axis=1)
                    for n, r in enumerate(rows_):
                        asked[r] = zone[first[which[n]]].tolist()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(asked, pa.list_(pa.int32())), pa.array(opened)], names=[*b.schema.names, "_zones", "_opened"])

        asked = parts.join(kth, "_k", "left").select("_k", "_c", "_v", "_p", "_r", F.coalesce("_t", F.lit(float("inf"))).alias("_t"))
        asked = stored(asked.mapInArrow(ask, f"_k {kinds['_k']}, _c {kinds['_c']}, _v array<double>, _p int, _r double, _t double, _zones array<int>, _opened int"), "neighbour-asked")
        if work is not None:
            pairs = parts.join(F.broadcast(sizes), F.col("_c") == F.col("_own")).agg(F.sum("_parts")).first()[0] or 0
            work |= {"pairs": pairs, "opened": parts.count() + (asked.agg(F.sum("_opened")).first()[0] or 0)}
        asking = asked.select("_c", F.explode("_zones").alias("_z")).groupBy("_c", "_z").count().collect()  # a row a zone
        sizes_of: dict[tuple, int] = {}
        for r in known:
            z = (r["_own"], zones[r["_own"], r["_part"]][0])
            sizes_of[z] = sizes_of.get(z, 0) + r["_rows"]
        # blocks of asking rows are of a zone's size
        even = {c: max(n for (own, _), n in sizes_of.items() if own == c) for c in radii}
        turns = {(r["_c"], r["_z"]): max(1, -(-r["count"] // min(even[r["_c"]], ZONE * block))) for r in asking}
        slices = {(c, z): n for (c, _), (z, n) in zones.items()}
        by_zone = local_table(spark, [(c, z, slices[c, z], n) for (c, z), n in turns.items()], f"_own {kinds['_c']}, _zone int, _slices int, _asking int")
        of_part = local_table(spark, [(c, p, z, n, turns[c, z]) for (c, p), (z, n) in zones.items() if (c, z) in turns], f"_own {kinds['_c']}, _part int, _z int, _slices int, _asking int")
        queries = asked.select("*", F.explode("_zones").alias("_z")).join(F.broadcast(by_zone), (F.col("_c") == F.col("_own")) & (F.col("_z") == F.col("_zone")))
        queries = queries.select("_c", "_z", at("_asking").alias("_i"), each("_slices").alias("_j"), "_k", "_v", "_p", "_r", "_t")
        data = parts.join(F.broadcast(of_part), in_part(parts)).select(again("_c"), again("_z"), each("_asking").alias("_i"), at("_slices").alias("_j"), again("_k"), again("_v"), again("_p"))
        by = ["_c", "_z", "_i", "_j"]
        found = queries.groupBy(*by).cogroup(data.groupBy(*by)).applyInArrow(_closer(k, pivots, radii), out).withColumn("_d", rounded(F.col("_d")))
        near = near.drop("place").unionByName(found)
        near = near.withColumn("place", place).where(F.col("place") <= k)
    elif work is not None:
        work |= {"pairs": parts.count(), "opened": parts.count()}
    return near.select(F.col("_k").alias(key), F.col("_n").alias("neighbour"), F.col("_d").alias("distance"), "place")


def _numbered(rows: DataFrame) -> DataFrame:
    """(_c, _k, _pick): the number of each key in its class, from 0 in order of keys; no task holds a class."""
    every = numbered(rows.select("_c", "_k"), ["_c", "_k"], "_pick")
    first = every.groupBy(F.col("_c").alias("_own")).agg(F.min("_pick").alias("_first"))
    return every.join(F.broadcast(first), F.col("_c") == F.col("_own")).select("_c", "_k", (F.col("_pick") - F.col("_first")).alias("_pick"))


def _draw(seed: str, what: str, n: Column) -> Column:
    """A number from 0 to n-1 by hash of seed, class and row number."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}-{what}"), F.col("_c").cast("string"), F.col("_i").cast("string"))), 1, 8), 16, 10).cast("long")
    return F.pmod(h, n)


def smote(df: DataFrame, key: str, label: str, vector: str, wanted: dict, k: int = 5, seed: str = "smote") -> DataFrame:
    """(label, i, vector): new rows of each class up to its target, between a row and one of its k
    nearest neighbours; a class of one row is repeated. Seed row, neighbour and place between them
    come from hashes of (seed, class, i). Rows must be finite. For training rows only.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    need = [(c, wanted[c] - counts[c], counts[c]) for c in wanted if c in counts and wanted[c] > counts[c]]
    spark = df.sparkSession
    kind = dict(df.dtypes)[label]
    plan = local_table(spark, need, f"_c {kind}, _need long, _n long")
    new = plan.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_need").cast("int") - 1))).withColumn("_pick", _draw(seed, "row", F.col("_n")))
    rows = df.where(F.col(label).isin(*(c for c, _, _ in need))).select(F.col(key).alias("_k"), F.col(label).alias("_c"), F.col(vector).cast("array<double>").alias("_v"))
    numbered = _numbered(rows).join(rows.drop("_c"), "_k")
    near = neighbours(df, key, label, vector, k, [c for c, _, _ in need]).select(F.col(key).alias("_k"), F.col("neighbour").alias("_m"), F.col("place").alias("_p"))
    seeded = new.join(numbered, ["_c", "_pick"]).withColumn("_kk", F.least(F.lit(k).cast("long"), F.col("_n") - 1))
    seeded = seeded.withColumn("_p", F.when(F.col("_kk") > 0, _draw(seed, "near", F.greatest(F.col("_kk"), F.lit(1))) + 1))
    seeded = seeded.withColumn("_u", _draw(seed, "between", F.lit(1_000_000)) / F.lit(1e6))
    joined = seeded.join(near, ["_k", "_p"], "left").join(rows.select(F.col("_k").alias("_m"), F.col("_v").alias("_w")), "_m", "left")
    between = F.zip_with("_v", F.coalesce("_w", "_v"), lambda a, b: a + F.col("_u") * (b - a))
    return joined.select(F.col("_c").alias(label), F.col("_i").alias("i"), between.alias(vector))


def tomek_links(df: DataFrame, key: str, label: str, vector: str, block: int = BLOCK, part_rows: int = PART_ROWS) -> DataFrame:
    """(key, other): mutual nearest neighbours of different classes, each pair once from either side.

    Nearest neighbours come from the metric index of neighbours(), over all classes at once.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(label).alias("_c"), F.col(vector).cast("array<double>").alias("_v"), F.lit(0).alias("_all"))
    nearest = stored(neighbours(rows, "_k", "_all", "_v", 1, block=block, part_rows=part_rows).select("_k", "neighbour"), "nearest")  # read twice
    both = nearest.alias("a").join(nearest.alias("b"), (F.col("a.neighbour") == F.col("b._k")) & (F.col("b.neighbour") == F.col("a._k")))
    pairs = both.select(F.col("a._k").alias("_k"), F.col("a.neighbour").alias("_m"))
    classes = rows.select("_k", "_c")
    out = pairs.join(classes, "_k").join(classes.select(F.col("_k").alias("_m"), F.col("_c").alias("_d")), "_m").where("_c != _d")
    return out.select(F.col("_k").alias(key), F.col("_m").alias("other"))


def drop_tomek(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    return df.join(tomek_links(df, key, label, vector).select(key).distinct(), key, "left_anti").select(*df.columns)


STRATEGIES = ("none", "class_weight", "oversample", "smote", "smote_tomek")


def resample(df: DataFrame, key: str, label: str, vector: str, strategy: str, wanted: dict, k: int = 5, seed: str = "smote") -> DataFrame:
    """(key, label, vector, synthetic) of training rows under a strategy; keys become strings.

    none and class_weight leave the rows (weights go to the model, see prep.class_weights); oversample
    repeats rows, smote adds new ones between neighbours, up to `wanted`; smote_tomek then drops the
    rows of Tomek links. Repeated and new rows have a key of their own.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"the strategy is one of {STRATEGIES}")
    rows = df.select(F.col(key).cast("string").alias(key), label, F.col(vector).cast("array<double>").alias(vector))
    if strategy in ("none", "class_weight"):
        return rows.withColumn("synthetic", F.lit(False))
    if strategy == "oversample":
        grown = oversample(rows, label, [key], wanted, seed)
        again = F.when(F.col("copy") > 0, F.concat_ws("#", key, "copy")).otherwise(F.col(key))
        return grown.select(again.alias(key), label, vector, (F.col("copy") > 0).alias("synthetic"))
    new = smote(df, key, label, vector, wanted, k, seed).select(F.concat_ws("+", F.col(label).cast("string"), F.col("i").cast("string")).alias(key), label, vector, F.lit(True).alias("synthetic"))
    out = rows.withColumn("synthetic", F.lit(False)).unionByName(new)
    return drop_tomek(stored(out, "smote"), key, label, vector) if strategy == "smote_tomek" else out


def before_after(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """(class, before, after, change, factor, imbalance): imbalance is the largest class over this one, after."""
    n = lambda d, name: d.groupBy(F.col(label).alias("class")).agg(F.count("*").alias(name))
    out = n(before, "before").join(n(after, "after"), "class", "full").na.fill(0, ["before", "after"])
    d = lambda c: F.col(c).cast("double")
    largest = F.max("after").over(Window.partitionBy()).cast("double")
    return out.select("class", "before", "after", (F.col("after") - F.col("before")).alias("change"), rounded(F.try_divide(d("after"), d("before"))).alias("factor"), rounded(F.try_divide(largest, d("after"))).alias("imbalance"))
