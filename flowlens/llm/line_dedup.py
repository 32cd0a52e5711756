"""Line dedup: repeated chunks of lines are removed, with the equal lines around them.

A text's lines are hashed; a rolling hash over the last `window` line hashes sets the ends of chunks.
An end depends on so many lines alone, so a line added before a passage does not shift the chunks
behind it. Several families of ends, from different bits of the hashes, cut each text several times: a
repeated run is found once it holds a whole chunk of one family. Hashes of chunks are counted in Spark;
the first occurrence of each repeated chunk sends its bytes, and those of the chunks before and behind
it, once to every group of texts that has the chunk. There the bytes are compared, and the equal run is
extended line by line to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.textops import buckets, fresh, is_long, replaced, slices, spread, spread_column, squeezed, text_bytes, unsqueezed, utf8

BLOCK_BYTES = 8 << 20
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
FAMILIES = 3


def cuts(lines: list[bytes], window: int, spacing: int, least: int, most: int, families: int) -> list[list[int]]:
    """For each family the first lines of its chunks, and the number of lines.

    A chunk ends at a line where the family's bits of the rolling hash are 0 modulo `spacing`, once it
    has `least` lines, or at `most` lines. A rest of fewer than `least` lines belongs to the chunk before.
    """
    rolled = hashes = [xxhash.xxh64_intdigest(line) for line in lines]
    if window > 1:
        gone, rolled, value = pow(BASE, window, MASK + 1), [], 0
        for k, h in enumerate(hashes):
            value = (value * BASE + h - (hashes[k - window] * gone if k >= window else 0)) & MASK
            rolled.append(value)
    out = []
    for family in range(families):
        shift, starts, at = 3 + 15 * (family % 4), [0], 0
        for k, h in enumerate(rolled, 1):
            if k - at >= least and (k - at >= most or (h >> shift) % spacing == 0):
                starts.append(k)
                at = k
        n = len(lines)
        if at < n and n - at < least and len(starts) > 1:
            starts.pop()
        out.append(starts if starts[-1] == n else [*starts, n])
    return out


def chunks(lines: list[bytes], *cut: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(first line of the chunk before, first line, stop, stop of the chunk behind, body) of every chunk of
    `least` lines and some word, once if families agree."""
    least = cut[2]
    seen = set()
    for starts in cuts(lines, *cut):
        for k in range(len(starts) - 1):
            a, b = starts[k], starts[k + 1]
            if b - a < least or (a, b) in seen:
                continue
            seen.add((a, b))
            body = b"\n".join(lines[a:b])
            if body.strip():
                yield starts[max(0, k - 1)], a, b, starts[min(k + 2, len(starts) - 1)], body


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def equal_run(lines: list[bytes], a: int, b: int, first: int, before: list[bytes], behind: list[bytes], same: bool) -> tuple[int, int]:
    """The run around lines[a:b] that equals the lines around line `first` of another place, where
    `before` and `behind` stand around the chunk; same: in the same text, where it may not overlap."""
    x, y, n = a, b, b - a
    for k, line in enumerate(reversed(before), 1):
        if a - k < 0 or lines[a - k] != line or (same and a - k < first + n):
            break
        x = a - k
    for k, line in enumerate(behind):
        if b + k >= len(lines) or lines[b + k] != line or (same and first + n + k >= x):
            break
        y = b + k + 1
    return x, y


def dedup_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 1,
    spacing: int = 2,
    least: int = 2,
    most: int = 64,
    families: int = FAMILIES,
) -> DataFrame:
    """df without repeated multi-line chunks and the equal lines around them.

    Of equal chunks with `least` (at least two) lines and some word, that in the smallest id, then
    earliest in its text, stays. The others are removed after their bytes were compared with it, and so
    are lines next to them, as far as they equal the lines next to the first, within the chunk before and
    the chunk behind. A repeated run that holds no whole chunk of any family stays. All is judged on
    the input, and each line that goes equals an earlier line that stays. The columns of df stay, but
    for `text_col` (what is left; null stays null) and new n_lines, n_lines_removed and n_chunks_removed
    (chunks found repeated, of any family), which replace columns of these names. An empty text has one
    empty line. Ids must be integers; a null id neither removes nor loses lines. Rows with one id count
    as one document: chunks at the same place of both are no repeats.
    """
    if least < 2 or most < least or window < 1 or spacing < 1 or not 1 <= families <= 4:
        raise ValueError("2 <= least <= most, 1 <= families <= 4, window and spacing positive")
    spark = df.sparkSession
    groups = buckets(spark, text_bytes(df, text_col)) + 1
    df = is_long(df, id_col)
    cut = (window, spacing, least, most, families)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk hash of a block and group of texts: the first place and how many there are."""
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), utf8(b.column(1))
            to = spread(ids, groups)
            for i, j in slices(texts, BLOCK_BYTES):
                hashes, docs, lines, grps = [], [], [], []
                for k in range(i, j):
                    for _, a, _, _, body in chunks(texts[k].split(b"\n"), *cut):
                        hashes.append(xxhash.xxh3_64_intdigest(body))
                        docs.append(ids[k])
                        lines.append(a)
                        grps.append(to[k])
                if not hashes:
                    continue
                h, d, at, g = np.array(hashes, np.uint64).view(np.int64), np.array(docs, np.int64), np.array(lines, np.int32), np.array(grps, np.int32)
                order = np.lexsort((at, d, g, h))
                h, d, at, g = h[order], d[order], at[order], g[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
                n = np.diff(np.append(new, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[new], d[new], at[new], g[new], n.astype(np.int64))], names=["hash", "doc", "line", "grp", "n"])

    texts = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col)
    seen = texts.mapInArrow(count, "hash long, doc long, line int, grp int, n long")
    repeated = seen.groupBy("hash").agg(F.min(F.struct("doc", "line")).alias("first"), F.sum("n").alias("n"), F.collect_set("grp").alias("grps")).where("n > 1")
    wanted = repeated.select("hash", "first.doc", "first.line", "grps", spread_column(F.col("first.doc"), groups).alias("grp"))

    group = fresh(df, "grp")
    left = squeezed(df, text_col).withColumn(group, spread_column(F.coalesce(F.col(id_col), F.xxhash64(text_col)), groups))

    def quote(docs: pa.Table, asked: pa.Table) -> pa.Table:
        """The bytes of asked chunks and of the chunks around them, for the groups that have them."""
        by: dict[int, dict[tuple[int, int], list[int]]] = {}
        for h, doc, line, grps in zip(*(asked.column(c).to_pylist() for c in ("hash", "doc", "line", "grps")), strict=True):
            by.setdefault(doc, {})[line, h] = grps
        rows = {}
        z = zstandard.ZstdCompressor(level=1)
        for doc, t in zip(docs.column(id_col).to_pylist(), unsqueezed(docs.column(text_col)), strict=True):
            if doc not in by or t is None:
                continue
            lines = t.split(b"\n")
            for p, a, b, q, body in chunks(lines, *cut):
                h = signed(xxhash.xxh3_64_intdigest(body))
                if (a, h) in by[doc]:
                    rows[h] = (h, doc, a, b - a, a - p, z.compress(b"\n".join(lines[p:q])), by[doc][a, h])
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
        columns = list(zip(*rows.values(), strict=True)) or [()] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["hash", "doc", "line", "size", "before", "body", "grps"])

    quoted = left.groupBy(group).cogroup(wanted.groupBy("grp")).applyInArrow(quote, "hash long, doc long, line int, size int, before int, body binary, grps array<int>")
    quoted = quoted.select(F.explode("grps").alias("grp"), "hash", "doc", "line", "size", "before", "body")

    counts = ["n_lines", "n_lines_removed", "n_chunks_removed"]
    new = [T.StructField(text_col, T.StringType()), *(T.StructField(c, T.LongType()) for c in counts)]
    schema = replaced(df.schema, new)
    kept_names = [f.name for f in schema.fields[: -len(new)]]

    def rebuild(docs: pa.Table, firsts: pa.Table) -> pa.Table:
        known = {h: k for k, h in enumerate(firsts.column("hash").to_pylist())}
        place = list(zip(*(firsts.column(c).to_pylist() for c in ("doc", "line", "size", "before")), strict=True))
        bodies, z = firsts.column("body"), zstandard.ZstdDecompressor()
        out: list[str | None] = []
        numbers: list[tuple[int, int, int]] = []
        for i, t in zip(docs.column(id_col).to_pylist(), unsqueezed(docs.column(text_col)), strict=True):
            if t is None or i is None or not known:
                out.append(None if t is None else t.decode())
                numbers.append((0 if t is None else t.count(b"\n") + 1, 0, 0))
                continue
            lines, found = t.split(b"\n"), 0
            gone = bytearray(len(lines))
            for _, a, b, _, body in chunks(lines, *cut):
                k = known.get(signed(xxhash.xxh3_64_intdigest(body)))
                if k is None or (i, a) <= place[k][:2]:
                    continue
                doc, line, size, before = place[k]
                other = z.decompress(bodies[k].as_py()).split(b"\n")
                if other[before : before + size] != lines[a:b]:
                    continue
                x, y = equal_run(lines, a, b, line, other[:before], other[before + size :], doc == i)
                gone[x:y] = b"\1" * (y - x)
                found += 1
            kept = [line for line, g in zip(lines, gone, strict=True) if not g]
            out.append(b"\n".join(kept).decode() if found else t.decode())
            numbers.append((len(lines), len(lines) - len(kept), found))
        new = [pa.array(out, pa.string()), *(pa.array([x[k] for x in numbers], pa.int64()) for k in range(3))]
        return pa.table([*(docs.column(c) for c in kept_names), *new], names=[*kept_names, text_col, *counts])

    return left.groupBy(group).cogroup(quoted.groupBy("grp")).applyInArrow(rebuild, schema)
