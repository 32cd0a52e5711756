"""The registry of queries: name -> function of (spark, folder), with the SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from flowlens.plans import q_data, q_evaluate, q_explain, q_features, q_models, q_prep, q_score, q_stream  # noqa: E402, F401
from flowlens.plans.q_models import flagship  # noqa: E402, F401
