"""WARC archives, written with an index and read by byte ranges.

Writing tasks append one compressed record per row to archives in a shared folder and return the
index: archive, offset, length, URL and digest of every record. Reading starts from index rows:
sorted by archive and offset, neighbouring ranges coalesce into single reads.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.storage import shared_folder, stored
from flowlens.llm.textops import partitions

INDEX = "archive string, offset bigint, length bigint, record_id bigint, url string, digest string, record_type string"
RECORD = "record_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
LEAST = 100  # bytes of a payload that revisits may refer to
#: Reading tasks up to which each reads about `most` bytes; beyond, bytes of a task.
TASKS, TASK_BYTES = 20_000, 256 << 20
CRLF = b"\r\n"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if urlsplit(path).scheme else (fs.LocalFileSystem(), path)


def _clean(url: str | None) -> bytes:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "").encode()


def _record(i: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = b"<urn:x-page:%d>" % i if i is not None else b"<urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"{digest}{url}")).encode()
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: " + name,
        b"WARC-Date: " + date.encode(),
        *([b"WARC-Target-URI: " + _clean(url)] if url is not None else []),
        *([b"X-Source-URI: " + quote(url, safe="").encode()] if url is not None and _clean(url).decode() != url else []),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
    ]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:x-page:%d>" % refers_to]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(CRLF.join(head) + CRLF * 2 + block + CRLF * 2) + z.flush()


def _parse(raw: bytes) -> dict:
    """A compressed record as the columns of RECORD; the payload of a response is verified."""
    import hashlib

    data = zlib.decompress(raw, 31)
    head, _, block = data.partition(CRLF * 2)
    fields = dict(x.split(b": ", 1) for x in head.split(CRLF)[1:])
    block = block[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(CRLF * 2)
    n = next(int(x.split(b": ", 1)[1]) for x in http.split(CRLF) if x.startswith(b"Content-Length"))
    digest = fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
    url = fields[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in fields else None
    page = lambda x: int(x[12:-1]) if x and x.startswith(b"<urn:x-page:") else None
    kind = fields[b"WARC-Type"].decode()
    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a record does not hold the payload of its digest")
    return {
        "record_id": page(fields[b"WARC-Record-ID"]),
        "url": unquote(fields[b"X-Source-URI"].decode()) if b"X-Source-URI" in fields else url,
        "payload_bytes": n,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page(fields.get(b"WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
    }


def digests(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, digest, refers_to) of each distinct id and payload: refers_to is the smallest id with an
    equal payload of LEAST bytes or more, null for that one itself."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    each = df.select(F.col(id_col).cast("long").alias("id"), F.sha2(payload, 256).alias("digest"), (F.octet_length(payload) >= LEAST).alias("large"))
    each = stored(each.distinct(), "warc-digests")
    # A digest may be that of a third of the rows: those with more than a mean partition are split into as
    # many parts as that takes. There are fewer of them than partitions, so the table of them is small.
    mean = max(1, -(-each.count() // partitions(df.sparkSession)))
    first = each.where("large and id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select("digest", "first", F.ceil(F.col("n") / mean).cast("int").alias("parts")), "warc-first")
    hot = first.where("parts > 1").select(F.col("digest").alias("hot"), F.col("parts").alias("own"))
    part = F.pmod(F.xxhash64("id"), F.coalesce("own", F.lit(1))).cast("int")
    split = each.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left").select("id", "digest", part.alias("part"))
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    out = split.join(first, ["digest", "part"], "left")
    return out.select("id", "digest", F.when(F.col("first") != F.col("id"), F.col("first")).alias("refers_to"))


def write_archives(
    df: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    archive_bytes: int = 64 << 20,
    date: str = "2026-01-01T00:00:00Z",
) -> DataFrame:
    """Writes a record per row and returns the index (columns of INDEX), itself stored.

    Payloads are the UTF-8 of `payload_col`; null counts as empty. Of rows with equal payloads of
    LEAST bytes or more, those with the smallest id are responses and the others revisits; smaller
    payloads and rows with a null id are always responses. Other columns are ignored. Each attempt
    of a task writes archives of its own name, so an archive of a lost task is never in the index.
    `folder` (default: one in the shared folder) must be of a scheme pyarrow.fs can write.
    """
    folder = folder or f"{shared_folder(df.sparkSession)}/warc-{uuid.uuid4().hex}"
    plan = digests(df, id_col, payload_col).alias("p")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest")).alias("r")
    rows = rows.join(plan, F.expr("r.id = p.id and r.digest = p.digest"), "left").select("r.id", "r.url", "r.payload", "r.digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = _open(folder)
        target.create_dir(base, recursive=True)
        name, out, at = "", None, 0
        for b in batches:
            index: list[tuple] = []
            for i, url, text, digest, refers_to in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = target.open_output_stream(f"{base}/{name}", compression=None)
                raw = _record(i, url, text.encode(), digest, refers_to, date)
                out.write(raw)
                index.append((f"{folder}/{name}", at, len(raw), i, url, digest, "response" if refers_to is None else "revisit"))
                at += len(raw)
                if at >= archive_bytes:
                    out.close()
                    out = None
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = [x.split()[0] for x in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in index], kind) for k, kind in enumerate(kinds)], names=names)
        if out is not None:
            out.close()

    return stored(rows.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records of index rows, as RECORD.

    Ranges of an archive less than `gap` bytes apart are read together, up to `most` bytes at once;
    tasks get about as many bytes each. URLs come back as they were: WARC-Target-URI has blanks and
    control characters escaped, and X-Source-URI then tells the original.
    Rows repeated in the index give repeated records. A revisit has the size and digest of the full
    payload, but no payload. A response whose payload does not match its digest raises an error.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(math.ceil(total / most), max(TASKS, math.ceil(total / TASK_BYTES))))
    ranges = index.select("archive", "offset", "length").repartition(tasks, "archive", F.floor(F.col("offset") / most)).sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

        def fetch(archive: str, group: list[tuple[int, int]]) -> pa.RecordBatch:
            source, path = _open(archive)
            start, stop = group[0][0], max(o + n for o, n in group)
            with source.open_input_file(path) as f:
                data = f.read_at(stop - start, start)
            rows = [_parse(data[o - start : o - start + n]) for o, n in group]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in zip(names, kinds, strict=True)], names=names)

        open_, group = "", []
        for b in batches:
            for archive, offset, length in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if group and (archive != open_ or offset - sum(group[-1]) > gap or offset + length - group[0][0] > most):
                    yield fetch(open_, group)
                    group = []
                open_ = archive
                group.append((offset, length))
        if group:
            yield fetch(open_, group)

    return ranges.mapInArrow(read, RECORD)
