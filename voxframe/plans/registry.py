"""Query registry: key -> (Spark builder, DuckDB oracle SQL).

Every registered builder gets ``(spark, sf_dir)`` and returns a lazy
DataFrame. Results are normalised for comparison only: integers widened to
bigint and floating columns rounded to 6 digits. The library functions the
builders call keep full precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.plans.oracle_views import with_views

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}
ROUND_DIGITS = 6


def normalise(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), ROUND_DIGITS)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def oracle(sql: str, *views: str, rnd: tuple[str, ...] | list[str] = (), extra: dict | None = None) -> str:
    """DuckDB oracle text: views as CTEs, listed double columns rounded."""
    body = with_views(sql, *views, extra=extra)
    if rnd:
        rep = ", ".join(f"round(CAST(\"{c}\" AS DOUBLE), {ROUND_DIGITS}) + 0.0 AS \"{c}\"" for c in rnd)  # no -0.0
        body = f"SELECT * REPLACE ({rep}) FROM ({body}) _o"
    return body


def register(key: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")

        def run(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
            return normalise(_fn(spark, sf_dir))

        run.__name__ = f"q_{key}"
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco
