"""Substring dedup: repeated token windows are removed.

Every window of `width` consecutive words gets a Rabin-Karp hash modulo 2**61 - 1, and EXTRA bytes of
a second one with another base. Tasks send each distinct hash of a block of texts once, packed with
its first place, to the bucket of its leading bits; a bucket counts its hashes and returns the places
of all but the first. The places of a document meet its text again, where covered words merge into
maximal removal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.textops import (
    BASES,
    Words,
    buckets,
    fresh,
    is_long,
    mix64,
    pack,
    pack_places,
    replaced,
    rolling,
    slices,
    spread,
    spread_column,
    squeezed,
    text_bytes,
    unpack,
    unpack_places,
    unsqueezed,
    utf8,
)

BLOCK_BYTES = 8 << 20
EXTRA = 2  # bytes of the second hash
SPAN = "array<struct<start:bigint,stop:bigint>>"


def _windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes, text number and first word (from 0 in its text) of every window inside one text."""
    hashes, second, docs, places = [], [], [], []
    for a, b in slices(texts):
        w = Words(texts[a:b])
        h = rolling(w.hash, width)
        if len(h):
            inside = np.flatnonzero(w.doc[: len(h)] == w.doc[width - 1 :])
            hashes.append(h[inside])
            second.append(rolling(w.hash, width, BASES[1])[inside] >> np.uint64(64 - 8 * EXTRA))
            docs.append(w.doc[inside] + a)
            places.append(inside - w.first[w.doc[inside]])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(second), np.concatenate(docs), np.concatenate(places)


def _send(bits: int, width: int):
    """Blocks of texts to packed rows (bucket, blob)."""
    shift, keep = np.uint64(64 - bits), 8 - bits // 8

    def block(ids: np.ndarray, texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
        order = np.argsort(ids, kind="stable")
        ids, texts = ids[order], [texts[i] for i in order]
        h, more, doc, pos = _windows(texts, width)
        doc = ids[doc]
        by = np.argsort(h, kind="stable")
        again = np.zeros(len(h), dtype=bool)
        again[by[1:]] = (h[by[1:]] == h[by[:-1]]) & (more[by[1:]] == more[by[:-1]])
        if again.any():  # repeats within the block need no comparison elsewhere
            at = np.flatnonzero(again)
            first = by[np.maximum.accumulate(np.where(again[by], 0, np.arange(len(by))))]
            origin = np.empty(len(h), dtype=np.int64)
            origin[by] = first
            same = (doc[at] == doc[origin[at]]) & (pos[at] == pos[origin[at]])  # a repeated row
            at = at[~same]
            for part in np.array_split(at, max(1, len(at) >> 16)):
                if len(part):
                    to = int(mix64(h[part[:1]])[0] >> shift)
                    yield to, pack(*pack_places(doc[part], pos[part]))
        at = np.flatnonzero(~again)
        to = (h[at] >> shift).astype(np.int32)
        order = np.argsort(to, kind="stable")
        at, to = at[order], to[order]
        edges = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else []
        for a, b in zip(edges[:-1], edges[1:], strict=False):
            part = at[a:b]
            low = h[part].view(np.uint8).reshape(-1, 8)[:, :keep]
            extra = more[part].view(np.uint8).reshape(-1, 8)[:, :EXTRA]
            yield int(to[a]), pack(*pack_places(doc[part], pos[part]), *extra.T, *low.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), utf8(b.column(1))
            for i, j in slices(texts, BLOCK_BYTES):
                rows = list(block(ids[i:j], texts[i:j]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                        names=["bucket", "blob"],
                    )

    return run


def packed_by_group(doc: np.ndarray, pos: np.ndarray, groups: int) -> pa.Table:
    """Places as one packed row for each group of documents."""
    to = spread(doc, groups).astype(np.int32)
    order = np.lexsort((pos, doc, to))
    doc, pos, to = doc[order], pos[order], to[order]
    edges = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else np.zeros(1, np.int64)
    blobs = [pack(*pack_places(doc[a:b], pos[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"grp": pa.array(to[edges[:-1]], pa.int32()), "places": pa.array(blobs, pa.binary())})


def _count(groups: int):
    """A bucket's rows to the places of windows that also start earlier."""

    def run(table: pa.Table) -> pa.Table:
        hashes, second, docs, places, known_doc, known_pos = [], [], [], [], [], []
        for blob in table.column("blob").to_pylist():
            ids, counts, pos, *low = unpack(blob)
            doc, pos = unpack_places(ids, counts, pos)
            if low:
                h, more = np.zeros((2, len(doc), 8), dtype=np.uint8)
                more[:, :EXTRA] = np.stack(low[:EXTRA], axis=1)
                h[:, : len(low) - EXTRA] = np.stack(low[EXTRA:], axis=1)
                hashes.append(h.view(np.uint64).reshape(-1))
                second.append(more.view(np.uint64).reshape(-1))
                docs.append(doc)
                places.append(pos)
            else:
                known_doc.append(doc)
                known_pos.append(pos)
        if hashes:
            h, more, doc, pos = np.concatenate(hashes), np.concatenate(second), np.concatenate(docs), np.concatenate(places)
            by = np.argsort(h, kind="stable")
            same = h[by[1:]] == h[by[:-1]]
            many = by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            h, more, doc, pos = h[many], more[many], doc[many], pos[many]
            by = np.lexsort((pos, doc, more, h))
            h, more, doc, pos = h[by], more[by], doc[by], pos[by]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (more[1:] != more[:-1])])[: len(h)]
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.zeros(0, int)
            later = (doc != doc[first]) | (pos != pos[first])
            known_doc.append(doc[later])
            known_pos.append(pos[later])
        if not known_doc:
            return packed_by_group(np.zeros(0, np.int64), np.zeros(0, np.int64), groups)
        return packed_by_group(np.concatenate(known_doc), np.concatenate(known_pos), groups)

    return run


def places_of(table: pa.Table) -> dict[int, np.ndarray]:
    """Packed places of a group as document -> sorted places."""
    if not table.num_rows:
        return {}
    docs, places = [], []
    for blob in table.column("places").to_pylist():
        doc, pos = unpack_places(*unpack(blob))
        docs.append(doc)
        places.append(pos)
    doc, pos = np.concatenate(docs), np.concatenate(places)
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    ids, at = np.unique(doc, return_index=True)
    return dict(zip(ids.tolist(), np.split(pos, at[1:]), strict=True))


def _spans(starts: np.ndarray, width: int) -> list[dict]:
    """Maximal intervals of words covered by the windows at starts (sorted)."""
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + width]))
    stops = np.append(starts[new[1:] - 1], starts[-1]) + width
    return [{"start": a, "stop": b} for a, b in zip(starts[new].tolist(), stops.tolist(), strict=True)]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """df with each word removed that a window covers which also starts earlier.

    Earlier: in a smaller id, or in the same text before. All windows are judged on the input.
    The columns of df stay, but for: `text_col` (kept words joined by one space, null stays null),
    and new n_words, n_removed, removed_spans (word ranges, stop excluded), which replace columns
    of these names. Empty and null texts have no word. A null id neither removes nor loses words.
    Rows with one id count as one document: a window at the same place of both is no repeat, and
    what is removed from one is removed at the same places of the other. Two windows count as
    equal if 80 bits of hashes are equal. Ids must be integers.
    """
    if width < 1:
        raise ValueError("width must be positive")
    spark = df.sparkSession
    size = buckets(spark, text_bytes(df, text_col))
    groups = size + 1
    df = is_long(df, id_col)
    texts = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col)
    sent = texts.mapInArrow(_send(size.bit_length() - 1, width), "bucket int, blob binary")
    found = sent.groupBy("bucket").applyInArrow(_count(groups), "grp int, places binary")
    new = [
        T.StructField(text_col, T.StringType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("removed_spans", T._parse_datatype_string(SPAN)),
    ]
    schema = replaced(df.schema, new)
    kept_names = [f.name for f in schema.fields[: -len(new)]]
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def rebuild(docs: pa.Table, places: pa.Table) -> pa.Table:
        starts = places_of(places)
        out, n_words, n_removed, spans = [], [], [], []
        for i, t in zip(docs.column(id_col).to_pylist(), unsqueezed(docs.column(text_col)), strict=True):
            words = (t or b"").split()
            got = starts.get(i)
            cut = _spans(got[got < max(1, len(words))], width) if got is not None and len(words) else []
            kept, at = [], 0
            for s in cut:
                s["stop"] = min(s["stop"], len(words))
                kept += words[at : s["start"]]
                at = s["stop"]
            kept = kept + words[at:] if cut else words
            out.append(None if t is None else b" ".join(kept).decode())
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            spans.append(cut)
        new = [pa.array(out, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, arrow_span)]
        return pa.table([*(docs.column(c) for c in kept_names), *new], names=[*kept_names, text_col, "n_words", "n_removed", "removed_spans"])

    group = fresh(df, "grp")
    left = squeezed(df, text_col).withColumn(group, spread_column(F.coalesce(F.col(id_col), F.xxhash64(text_col)), groups))
    return left.groupBy(group).cogroup(found.groupBy("grp")).applyInArrow(rebuild, schema)
