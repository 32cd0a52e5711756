"""N-gram Jaccard join through a token-group matrix.

Texts with one shingle set are one class. Classes that share a popular min-hash form a group, all
else is a group of its own; a first look within bounded blocks of a group finds easy links. The
matrix holds the union of each group's rare shingles, of which a qualifying pair must share a stated
number. A class is a query: the matrix bounds its overlap with each group's union, and only groups
that reach the number are opened: their texts are shipped, the whole union of a block's shingles
bounds the overlap again, and what is left is compared. Links then merge into components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.graph import components
from flowlens.llm.storage import stored
from flowlens.llm.textops import Words, buckets, is_long, mix64, pack, rolling, slices, squeezed, text_bytes, unpack, utf8

KEYS = 6
SEEDS = mix64(np.arange(1, KEYS + 1, dtype=np.uint64))
#: Parts of the count sketch, and the bits of a cell's number at least and at most.
SKETCH_PARTS, SKETCH_LEAST, SKETCH_MOST = 64, 16, 24
#: Texts of a block of the first look; shingles of members, and queries, of an opened block; about.
LOOK, SHINGLES, QUERIES = 64, 32_000, 128
BLOCK_BYTES = 8 << 20
#: A rare shingle more for each so many of a text; its links share as many more.
STEP = 20


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of fewer words than `width`, that of all words."""
    for a, b in slices(texts):
        w = Words(texts[a:b], lower=True)
        h = rolling(w.hash, width)
        for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if j - i >= width:
                yield np.unique(h[i : j - width + 1])
            elif j > i:
                yield rolling(w.hash[i:j], j - i)
            else:
                yield np.zeros(0, np.uint64)


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def min_hashes(s: np.ndarray) -> np.ndarray:
    return np.array([mix64(s ^ seed).min() for seed in SEEDS])


def common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = common(a, b)
    return 100 * both >= percent * (small + large - both)


def sketch_bits(size: int) -> int:
    """For `size` bytes of text: a cell for some 40 shingles, up to 2**SKETCH_MOST cells."""
    return min(SKETCH_MOST, max(SKETCH_LEAST, (size >> 8).bit_length()))


def _describe(width: int, cell_bits: int):
    """A row per text: id, n, digest, keys; and, of each task, its part of the count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "digest", "keys", "part", "counts"]
        counts = np.zeros(1 << cell_bits, dtype=np.int64)
        keys_type = pa.list_(pa.int64())
        for b in batches:
            texts, n, digests, keys = utf8(b.column(1)), [], [], []
            pending: list[np.ndarray] = []
            held = 0
            for s in shingle_sets(texts, width):
                n.append(len(s))
                digests.append(digest(s))
                keys.append(min_hashes(s).view(np.int64).tolist() if len(s) else [])
                pending.append(s)
                held += len(s)
                if held >= 1 << 20:
                    counts += np.bincount(np.concatenate(pending) >> np.uint64(64 - cell_bits), minlength=len(counts))
                    pending, held = [], 0
            if pending:
                counts += np.bincount(np.concatenate(pending) >> np.uint64(64 - cell_bits), minlength=len(counts))
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, keys_type), none.cast(pa.int32()), none.cast(pa.binary())],
                names=names,
            )
        parts = [pack(x) for x in np.split(counts, SKETCH_PARTS)]
        none = pa.nulls(SKETCH_PARTS)
        yield pa.RecordBatch.from_arrays(
            [none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(keys_type), pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())],
            names=names,
        )

    return run


def _sketch(described: DataFrame, cell_bits: int) -> np.ndarray:
    """Counts of shingles by leading bits, of a bounded size whatever the input; they only order shingles."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpack(x)[0] for x in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([pack(total)], pa.binary())})

    rows = described.where("part is not null").select("part", "counts", F.pmod(F.xxhash64("counts"), F.lit(256)).alias("salt"))
    some = rows.groupBy("part", "salt").applyInArrow(add, "part int, counts binary")
    rows = some.groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    counts = np.zeros(1 << cell_bits, dtype=np.int64)
    size = len(counts) // SKETCH_PARTS
    for r in rows:
        counts[r["part"] * size : (r["part"] + 1) * size] = unpack(r["counts"])[0]
    scale = max(1, int(counts.mean()) // 1000)
    return np.minimum(counts // scale, 65535).astype(np.uint16)


def _send_prefixes(width: int, percent: int, bits: int, cell_bits: int, counts: Broadcast):
    """The rare shingles of each text.

    A link shares `percent` of the larger set. So of the n - least + k rarest shingles of both, in
    one order, it shares k at least; k grows with n.
    """
    shift, keep = np.uint64(64 - bits), 8 - bits // 8

    def block(ids: np.ndarray, texts: list[bytes]) -> list[tuple[int, bytes]]:
        order = np.argsort(ids, kind="stable")
        frequency, seen = counts.value, set()
        hashes, docs, sizes = [], [], []
        for i, s in zip(order, shingle_sets([texts[i] for i in order], width), strict=True):
            name = digest(s)
            if not len(s) or name in seen:
                continue
            seen.add(name)
            n = len(s)
            p = n - (percent * n + 99) // 100 + 1 + n // STEP
            rare = np.lexsort((s, frequency[s >> np.uint64(64 - cell_bits)]))[:p]
            hashes.append(s[rare])
            docs.append(np.full(p, ids[i]))
            sizes.append(np.full(p, n, dtype=np.int32))
        if not hashes:
            return []
        h, doc, n = np.concatenate(hashes), np.concatenate(docs), np.concatenate(sizes)
        to = (h >> shift).astype(np.int32)
        by = np.argsort(to, kind="stable")
        h, doc, n, to = h[by], doc[by], n[by], to[by]
        edges = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
        rows = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            d, m = doc[a:b], n[a:b]
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (m[1:] != m[:-1])]))
            per = np.diff(np.append(new, b - a)).astype(np.int32)
            rows.append((int(to[a]), pack(np.diff(d[new], prepend=np.int64(0)), per, m[new], *h[a:b].view(np.uint8).reshape(-1, 8)[:, :keep].T)))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), utf8(b.column(1))
            for i, j in slices(texts, BLOCK_BYTES):
                rows = block(ids[i:j], texts[i:j])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

    return run


def _shared_tokens(table: pa.Table) -> pa.Table:
    """(token, id, n) of the bucket's tokens that two texts have."""
    hashes, docs, sizes = [], [], []
    for blob in table.column("blob").to_pylist():
        places, per, n, *low = unpack(blob)
        h = np.zeros((len(low[0]), 8), dtype=np.uint8)
        h[:, : len(low)] = np.stack(low, axis=1)
        hashes.append(h.view(np.uint64).reshape(-1))
        docs.append(np.repeat(np.cumsum(places), per))
        sizes.append(np.repeat(n, per))
    h, doc, n = np.concatenate(hashes), np.concatenate(docs), np.concatenate(sizes)
    by = np.argsort(h, kind="stable")
    same = h[by[1:]] == h[by[:-1]]
    by = by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    # Leading bytes left out in the blob are the same in a bucket: with it they make the token unique.
    token = mix64(h[by] + np.uint64(table.column("bucket")[0].as_py() * 0x9E3779B97F4A7C15 % (1 << 64)))
    return pa.table({"token": pa.array(token.view(np.int64)), "id": pa.array(doc[by]), "n": pa.array(n[by].astype(np.int64))})


def _texts(table: pa.Table) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(x) for x in table.column("text").to_pylist()]


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})


def _cluster(width: int, percent: int):
    """Links of a block's texts to leaders; the pivots of its key lead first."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pivot", "descending"), ("id", "ascending")])
        ids, out = table.column("id").to_pylist(), []
        leaders: list[tuple[int, np.ndarray]] = []
        marks = np.zeros((table.num_rows, KEYS), dtype=np.uint64)
        for i, s in zip(ids, shingle_sets(_texts(table), width), strict=True):
            if not len(s):
                continue
            own = min_hashes(s)
            for k in np.flatnonzero((marks[: len(leaders)] == own).sum(axis=1) >= 2):
                if similar(s, leaders[k][1], percent):
                    out.append((i, leaders[k][0]))
                    break
            else:
                marks[len(leaders)] = own
                leaders.append((i, s))
        return _edges(out)

    return run


def _open(width: int, percent: int):
    """Links of a block's queries to its members: one for each component among the members."""

    def run(table: pa.Table) -> pa.Table:
        member = np.array(table.column("member").to_pylist())
        ids, comps = table.column("id").to_numpy(), table.column("comp").to_numpy()
        sets = list(shingle_sets(_texts(table.filter(pa.array(member))), width))
        if not sets:
            return _edges([])
        sizes = np.array([len(s) for s in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(tokens, kind="stable")
        owner = owner[order]
        union, first = np.unique(tokens[order], return_index=True)
        last = np.append(first[1:], len(tokens))
        own_ids, own_comps = ids[member], comps[member]
        asking, out = table.filter(pa.array(~member)), []
        for i, c, s in zip(ids[~member].tolist(), comps[~member].tolist(), shingle_sets(_texts(asking), width), strict=True):
            at = np.searchsorted(union, s)
            at[at == len(union)] = 0
            at = at[union[at] == s]
            if not len(s) or 100 * len(at) < percent * len(s):  # the bound: overlap with the union
                continue
            n = last[at] - first[at]
            places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)
            both = np.bincount(owner[places], minlength=len(sets))
            linked = np.flatnonzero((100 * both >= percent * (sizes + len(s) - both)) & (own_comps != c))
            out += [(i, int(own_ids[k])) for k in linked[np.unique(own_comps[linked], return_index=True)[1]]]
        return _edges(out)

    return run


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id): a row per row of df; its other columns are ignored.

    A text's set: distinct runs of `width` words, ASCII lower-cased; with fewer words, all of them
    as one; without words, or null, empty. Texts link when 100 * intersection >= percent * union;
    empty sets link with nothing. component_id: the smallest id reachable by links, itself included
    (null for a null id, which links with nothing). Rows of one id are judged each by its own text;
    where two such texts are each the first of their class, their components count as one. Shingles
    count as equal if their 61-bit hashes are. Ids must be integers.
    """
    spark = df.sparkSession
    docs = is_long(df.select(id_col, text_col), id_col).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = docs.where("id is not null")
    size = text_bytes(known, "text")
    cell_bits = sketch_bits(size)
    described = stored(docs.mapInArrow(_describe(width, cell_bits), "id bigint, n bigint, digest binary, keys array<bigint>, part int, counts binary"), "join-sets")
    sets = described.where("part is null").select("id", "n", "digest", "keys")
    frequency = spark.sparkContext.broadcast(_sketch(described, cell_bits))  # 32 MiB at most

    # Classes of equal sets, each by its smallest id.
    classes = stored(sets.where("n > 0 and id is not null").groupBy("digest", "n").agg(F.min("id").alias("id"), F.first("keys").alias("keys")), "join-classes")

    # Blocks of classes that share a popular min-hash; two pivots stand in every block of a key.
    keyed = classes.select("id", "n", F.explode("keys").alias("key"))
    by_hash = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("id"))
    popular = keyed.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min(by_hash)["id"].alias("p"), F.max(by_hash)["id"].alias("q")).where("size > 1")
    popular = stored(popular, "join-keys")
    chosen = keyed.join(popular, "key").groupBy("id").agg(F.max(F.struct("size", "key", "p", "q", "shingles")).alias("k")).select("id", "k.*")
    blocks = F.greatest(F.ceil(F.col("size") / LOOK), F.ceil(F.col("shingles") / SHINGLES))
    block = F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int")
    placed = stored(chosen.select("id", "key", "p", "q", block.alias("block")), "join-placed")
    pivots = placed.select("key", "block", F.explode(F.array("p", "q")).alias("id")).distinct().withColumn("pivot", F.lit(True))
    own = placed.where("id != p and id != q").select("key", "block", "id", F.lit(False).alias("pivot"))
    packed = squeezed(known, "text")
    near = packed.join(own.unionByName(pivots), "id").groupBy("key", "block").applyInArrow(_cluster(width, percent), "u bigint, v bigint")
    hints = stored(near, "join-hints")
    grouped = components(hints)

    # The token-group matrix, over the shingles that a link must share.
    bits = buckets(spark, size).bit_length() - 1
    sent = known.mapInArrow(_send_prefixes(width, percent, bits, cell_bits, frequency), "bucket int, blob binary")
    shared = sent.groupBy("bucket").applyInArrow(_shared_tokens, "token bigint, id bigint, n bigint")
    firsts = classes.groupBy("id").agg(F.max("n").alias("size"))
    keys = placed.select("id", F.col("key").alias("grp"))
    labels = firsts.join(keys, "id", "left").join(grouped.withColumnRenamed("node", "id"), "id", "left")
    labels = stored(labels.select("id", "size", F.coalesce("grp", "id").alias("grp"), F.coalesce("component", "id").alias("comp")), "join-groups")
    tokens = stored(shared.join(labels, "id").select("token", "id", "n", "grp", "comp"), "join-tokens")
    matrix = tokens.groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    queries = tokens.select("token", F.col("id").alias("query"), "n", F.col("grp").alias("own"), "comp")
    fits = (100 * F.col("most") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("least"))
    apart = (F.col("c0") != F.col("comp")) | (F.col("c1") != F.col("comp"))
    met = queries.join(matrix, "token").where((F.col("own") <= F.col("grp")) & apart & fits)
    overlap = met.groupBy("query", "comp", "n", "grp").agg(F.count("*").alias("overlap"))  # with the group's union
    least = F.floor(F.ceil(percent * F.col("n") / 100) / STEP) + 1
    wanted = stored(overlap.where(F.col("overlap") >= least).select("query", "comp", "grp").distinct(), "join-wanted")

    # Open the groups: bounded blocks of members and of queries meet.
    asked = wanted.groupBy("grp").agg(F.count("*").alias("asking"))
    sizes = labels.groupBy("grp").agg(F.sum("size").alias("shingles")).join(asked, "grp")
    sizes = sizes.select("grp", F.ceil(F.col("shingles") / SHINGLES).cast("int").alias("mb"), F.ceil(F.col("asking") / QUERIES).cast("int").alias("qb"))
    sizes = stored(sizes, "join-sizes")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    at = lambda c, n: F.pmod(F.xxhash64(c, F.lit(2)), F.col(n)).cast("int")
    members = labels.join(sizes, "grp").select("id", "comp", "grp", at("id", "mb").alias("m"), each("qb").alias("q"), F.lit(True).alias("member"))
    asking = wanted.join(sizes, "grp").select(F.col("query").alias("id"), "comp", "grp", each("mb").alias("m"), at("query", "qb").alias("q"), F.lit(False).alias("member"))
    opened = packed.join(members.unionByName(asking), "id").groupBy("grp", "m", "q").applyInArrow(_open(width, percent), "u bigint, v bigint")

    # Both kinds of links make the components.
    links = hints.union(opened)
    final = components(links)
    smallest = classes.select("digest", F.col("id").alias("first")).join(final.withColumnRenamed("node", "first"), "first", "left")
    smallest = smallest.select("digest", F.coalesce("component", "first").alias("least"))
    out = sets.join(smallest, "digest", "left")
    reached = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), reached.alias("component_id"))


def drop_near_copies(df: DataFrame, joined: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """df with one document of each component: that whose id is the component's; null ids stay."""
    firsts = joined.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    return df.where(F.col(id_col).isNotNull()).join(firsts, id_col, "left_semi").select(*df.columns).union(df.where(F.col(id_col).isNull()))
