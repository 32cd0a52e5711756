"""Rows as blocks of bytes, for fits that read them many times."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame

#: Bytes of a partition's rows, about; fewer rows than FEW aren't dealt anew.
BYTES, FEW = 32 << 20, 200_000
BLOCK = 8192  # rows of a block: some operations on 2,048 took twice as long a row


def blocks(table: DataFrame, d: int, n: int) -> DataFrame:
    """The n rows of a table of d features, a class and a weight (doubles, int, double), in even partitions and kept by Spark
    until unpersist(): features a line each, a null as NaN."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)]) if d else np.zeros((0, b.num_rows))
            y, w = b.column(d).to_numpy(zero_copy_only=False).astype(np.int32), b.column(d + 1).to_numpy(zero_copy_only=False)
            parts = [slice(at, at + BLOCK) for at in range(0, len(y), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([a[..., p].tobytes() for p in parts], pa.binary()) for a in (x, y, w)], names=["x", "y", "w"])

    if n >= FEW:
        cores = table.sparkSession.sparkContext.defaultParallelism
        table = table.repartition(cores * -(-n * 8 * (d + 2) // (BYTES * cores)))
    return table.mapInArrow(packed, "x binary, y binary, w binary").persist(StorageLevel.MEMORY_AND_DISK)


def opened(batch: pa.RecordBatch, d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, classes, weights) of each block of a batch."""
    for x, y, w in zip(*batch.columns, strict=True):
        classes = np.frombuffer(y.as_buffer(), np.int32)
        yield np.frombuffer(x.as_buffer()).reshape(d, len(classes)), classes, np.frombuffer(w.as_buffer())
