"""Named queries with optional SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` computes the same rows on the same tables."""

    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query registered twice: {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return register


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Added before rounding, so that exact ties (an average of four prices ends in
#: 25 or 75) do not depend on how an engine rounds halves.
TIE_SHIFT = 1e-10


def rounded(df: DataFrame, decimals: int = 6, keep: Sequence[str] = ()) -> DataFrame:
    """Round floating columns: the order of a sum is not part of a result."""
    return df.select(
        *[
            F.round(F.col(f.name) + F.lit(TIE_SHIFT), decimals).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in keep
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def r(expression: str, name: str | None = None, decimals: int = 6) -> str:
    """SQL text of a value rounded the way :func:`rounded` does."""
    return f"round(cast({expression} as double) + {TIE_SHIFT:.10f}, {decimals}) as {name or expression}"
