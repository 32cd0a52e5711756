"""Small tables from Python rows."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows as a local relation: its size is known to the optimizer, and it needs no task to read."""
    kind = T._parse_datatype_string(schema)
    data = [dict(zip(kind.names, r, strict=True)) for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=to_arrow_schema(kind)), schema=kind)
