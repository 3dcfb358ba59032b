"""Query registry: one Spark plan and (where SQL can express it) one DuckDB oracle per key.

Numeric outputs that come from floating-point aggregation are normalised to
6 decimals (half-even in both engines) so that summation order cannot change
the value hash; report-level rounding from the reference is applied on top
where the reference itself rounds.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmetrics.functions.numeric import round_half_even
from postmetrics.session import ensure_checkpoint_dir, make_importable

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = wrapped
        if sql is not None:
            ORACLE[key] = sql.strip()
        return wrapped
    return deco


def prepare(spark: SparkSession) -> None:
    """Semantics the operators rely on: UTC wall clock, a checkpoint location."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    make_importable(spark)


def r6(c) -> Column:
    return round_half_even(c, 6)


def ts_text(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# SQL fragments shared by the oracle strings
SQL_TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
SQL_POSTS = """posts AS (
  SELECT event_id AS post_id, user_id AS author_id, ts AS post_datetime,
         event_type AS category, value AS engagement,
         TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""
SQL_CAP95 = "(SELECT quantile_cont(value, 0.95) FROM events)"
