"""Grouped statistics behind the engagement reports.

All aggregates are hash aggregates with map-side partial combination, so a hot
group costs one partial buffer per map task, not one task holding the group.
Medians/quantiles go through ``operators.quantiles`` (size-checked strategy).
pandas semantics kept: NULL group keys are dropped (T5), ``count`` counts
non-null values, the sample std of a single row is NULL.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmetrics.functions.features import winsorize
from postmetrics.functions.numeric import round_half_even
from postmetrics.operators.quantiles import quantiles, scalar_quantile_frame


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond) if cond is not None else df


def cap_value(df: DataFrame, value: str, q: float, method: str = "auto") -> float | None:
    """The ``q`` quantile of a column as a number (one job); None without values."""
    return scalar_quantile_frame(df, value, q, "_cap", method).first()["_cap"]


def cap_column(df: DataFrame, value: str, q: float, out: str,
               scope: DataFrame | None = None, method: str = "auto") -> DataFrame:
    """Winsorize: clip ``value`` at its ``q`` quantile computed over ``scope`` (default: df).

    The cap is computed once, here, and is a literal in every later plan: a plan over the capped
    column does not carry the plan of its quantile.
    """
    cap = cap_value(scope if scope is not None else df, value, q, method)
    return df.withColumn(out, winsorize(F.col(value), F.lit(cap).cast("double")))


def group_stats(df: DataFrame, keys: Sequence[str], value: str,
                stats: Sequence[str] = ("count", "mean", "median", "std"),
                names: dict | None = None, quantile_method: str = "auto") -> DataFrame:
    """count / mean / median / std / min / max / sum of ``value`` per group."""
    keys = list(keys)
    names = dict(names or {})
    data = drop_null_keys(df, keys)
    v = F.col(value)
    simple = {
        "count": F.count(v).cast("bigint"),
        "mean": F.avg(v),
        "std": F.stddev_samp(v),
        "min": F.min(v),
        "max": F.max(v),
        "sum": F.sum(v),
    }
    want_median = "median" in stats
    method = quantile_method
    aggs = [simple[s].alias(names.get(s, s)) for s in stats if s in simple]
    if want_median and method == "builtin":
        aggs.append(F.median(v).alias(names.get("median", "median")))
    out = data.groupBy(*keys).agg(*aggs)
    if want_median and method != "builtin":
        med = quantiles(data, value, [0.5], keys, [names.get("median", "median")], method)
        out = out.join(med, keys, "left")
    order = [names.get(s, s) for s in stats]
    return out.select(*keys, *order)


def value_counts(df: DataFrame, key: str, name: str = "count") -> DataFrame:
    """Frequency table (NULL dropped), count descending then key."""
    return (drop_null_keys(df, [key]).groupBy(key).agg(F.count(F.lit(1)).alias(name)))


def bool_share(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Long table (feature, share) = mean of each boolean flag."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in flags
    ])).alias("s")).select("s.*")
    return stacked.groupBy("feature").agg(F.avg("x").alias("share"))


def pivot_mean(df: DataFrame, row_key: str, col_key: str, value: str,
               levels: Sequence | None = None, max_levels: int = 10_000) -> DataFrame:
    """row_key x col_key matrix of means; empty cells NULL.

    Levels are listed explicitly so Spark skips its distinct pre-job; when not
    given they are computed with a size guard.
    """
    data = drop_null_keys(df, [row_key, col_key])
    if levels is None:
        lv = data.select(col_key).distinct().limit(max_levels + 1).collect()
        if len(lv) > max_levels:
            raise ValueError(f"pivot on {col_key}: more than {max_levels} levels")
        levels = sorted(r[0] for r in lv)
    return data.groupBy(row_key).pivot(col_key, list(levels)).agg(F.avg(value))


def ratio_of_rounded(top: Column, second: Column, digits: int = 1) -> Column:
    """Report rule: round both means (half-even) first, then divide; guarded."""
    return F.try_divide(round_half_even(top, digits), round_half_even(second, digits))


def box_stats(df: DataFrame, key: str, value: str, method: str = "auto") -> DataFrame:
    """Box-plot table per group: quartiles, 1.5-IQR whiskers (most extreme data within
    the fences) and the number of points outside them."""
    data = drop_null_keys(df, [key]).where(F.col(value).isNotNull())
    q = quantiles(data, value, [0.25, 0.5, 0.75], [key], ["q1", "median", "q3"], method)
    j = data.join(q, key)
    iqr = F.col("q3") - F.col("q1")
    lo_f = F.col("q1") - 1.5 * iqr
    hi_f = F.col("q3") + 1.5 * iqr
    v = F.col(value)
    return j.groupBy(key).agg(
        F.count(v).cast("bigint").alias("n"),
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(v >= lo_f, v)).alias("whisker_low"),
        F.max(F.when(v <= hi_f, v)).alias("whisker_high"),
        F.count(F.when((v < lo_f) | (v > hi_f), v)).cast("bigint").alias("n_outliers"),
    )


def mode_value(df: DataFrame, col: str, name: str = "mode") -> DataFrame:
    """Most frequent non-null value; ties -> smallest value (deterministic).

    Counting is a partial aggregate; picking the winner keeps O(1) state
    (``min_by`` over the (-count, value) ordering).
    """
    counts = drop_null_keys(df, [col]).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.min_by(F.col(col), F.struct(-F.col("_n"), F.col(col))).alias(name))
