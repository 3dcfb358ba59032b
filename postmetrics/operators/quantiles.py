"""Exact, linearly interpolated quantiles (pandas ``quantile`` / DuckDB ``quantile_cont``).

``radix`` (``auto``) selects order statistics digit by digit, without sorting rows or writing tables:

1. every value falls into the bucket of its leading bits (sign, exponent, 8 bits of the mantissa);
   one aggregation per group counts the buckets and keeps their smallest and largest value, and
   running counts show which bucket holds each wanted rank;
2. rows of those buckets only are counted again by 65,536 equal steps between the bucket's ends;
3. what is still open is counted by the values themselves, equal ones collapsed.

A rank is settled as soon as its bucket holds a single value, or it is the bucket's first or last row.
Every count is a hash aggregate with partial counts per task, so a hot group costs one row per bucket
and task.

Where the buckets of all wanted ranks are at most ``FEW`` rows (checked on the result of the first
count), each digit is one job, the buckets are broadcast to the next scan, no scan follows once
all ranks are settled, and the result is a table of numbers: plans that use it do not carry the plan of
the selection.  With more groups the remaining digits are joined lazily, in the plan of the result.
Either way the source is scanned at most four times.

``sort`` positions all rows by a distributed sort (``ordinal``).  ``builtin`` is Spark's exact
``percentile``, only when a caller names it: its buffer holds a group's distinct values in one task.
``approx`` (``percentile_approx``) is for callers that accept rank error.
"""

from __future__ import annotations

import math
from typing import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmetrics.operators.ordinal import with_group_position


def _names(probs, names):
    if names is None:
        names = [f"q{int(round(p * 100)):02d}" if abs(p * 100 - round(p * 100)) < 1e-9
                 else f"q{str(p).replace('.', '_')}" for p in probs]
    return list(names)


def quantiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (),
              names: Sequence[str] | None = None, method: str = "auto") -> DataFrame:
    """One row per group (or one row) with one column per probability.

    Nulls in ``value`` are ignored; a group with no values yields NULL.
    """
    groups = list(groups)
    probs = [float(p) for p in probs]
    names = _names(probs, names)
    if method == "auto":
        method = "radix"
    if method == "builtin":
        arr = F.percentile(F.col(value), F.array(*[F.lit(p) for p in probs]))
        base = (df.groupBy(*groups).agg(arr.alias("_qs")) if groups else df.agg(arr.alias("_qs")))
        return base.select(*groups, *[F.col("_qs")[i].alias(n) for i, n in enumerate(names)])
    if method == "approx":
        arr = F.percentile_approx(F.col(value), list(probs), 100_000)
        base = (df.groupBy(*groups).agg(arr.alias("_qs")) if groups else df.agg(arr.alias("_qs")))
        return base.select(*groups, *[F.col("_qs")[i].cast("double").alias(n) for i, n in enumerate(names)])
    if method == "radix":
        return _radix_quantiles(df, value, probs, groups, names)
    if method != "sort":
        raise ValueError(f"unknown quantile method {method!r}")
    return _sorted_quantiles(df, value, probs, groups, names)


#: Mantissa bits of the first digit; steps of the second.
LEADING_BITS = 8
STEPS = 1 << 16
#: Buckets of wanted ranks that the driver may hold: above, they stay distributed.
FEW = 10_000


def leading_bits(v: Column) -> Column:
    """Sign, exponent and first ``LEADING_BITS`` mantissa bits of a double as an ordered integer.

    The exponent is estimated by a logarithm and put right by an exact scaling, so equal values give
    equal digits on every machine.  Values below 2**-1022 count as zero; NaN comes last.
    """
    size = F.abs(v)
    guess = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1021)), F.lit(1022))
    scaled = size * F.pow(F.lit(2.0), -guess)
    up, down = scaled >= 2, scaled < 1
    exponent = guess + F.when(up, 1).when(down, -1).otherwise(0)
    mantissa = F.when(up, scaled / 2).when(down, scaled * 2).otherwise(scaled)
    digit = ((exponent + 1100) * (1 << LEADING_BITS) + F.floor((mantissa - 1) * (1 << LEADING_BITS))).cast("long")
    far = F.lit(2200 << LEADING_BITS).cast("long")
    digit = F.when(size == float("inf"), far).when(size < 2.0 ** -1022, F.lit(0).cast("long")).otherwise(digit)
    return F.when(v.isNull(), None).when(F.isnan(v), far + 1).when(v < 0, -digit).otherwise(digit)


def _matched(left: DataFrame, right: DataFrame, on: Sequence[str], more: Column | None = None, how: str = "inner") -> DataFrame:
    """Join on columns of the same names, where NULL matches NULL; the left ones stay."""
    other = right.select(*[F.col(c).alias(f"_r{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_r{c}"))
        cond = same if cond is None else cond & same
    return left.join(other, cond if more is None else cond & more, how).drop(*[f"_r{c}" for c in on])


def _buckets(rows: DataFrame, path: Sequence[str], digit: str) -> DataFrame:
    """Rows, smallest and largest value per digit, and the number of rows of smaller digits of the path."""
    hist = rows.groupBy(*path, digit).agg(F.count("_v").alias("_n"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    w = Window.partitionBy(*path).orderBy(digit)
    return hist.withColumn("_before", F.sum("_n").over(w) - F.col("_n"))


def _settled(off: str = "_off") -> Column:
    return (F.when((F.col("_mn") == F.col("_mx")) | (F.col(off) == 0), F.col("_mn"))
            .when(F.col(off) == F.col("_n") - 1, F.col("_mx")))


def _first_buckets(rows: DataFrame, key: list[str], probs) -> DataFrame:
    """First digit: the bucket of every wanted rank; each group's first bucket also has a row without rank."""
    hist = _buckets(rows, key, "_d0")
    hist = hist.withColumn("_total", F.sum("_n").over(Window.partitionBy(*key)))
    ranks = []
    for i, p in enumerate(probs):
        rank = (F.col("_total") - 1) * F.lit(p)
        ranks += [F.struct(F.lit(2 * i + side).alias("i"), f(rank).cast("long").alias("rank")) for side, f in enumerate((F.floor, F.ceil))]
    held = F.filter(F.array(*ranks), lambda r: (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + F.col("_n")))
    found = hist.withColumn("_t", F.explode_outer(held)).where(F.col("_t").isNotNull() | (F.col("_before") == 0))
    found = found.select(*key, "_d0", "_n", "_mn", "_mx", "_total", F.col("_t.i").alias("_i"),
                         (F.col("_t.rank") - F.col("_before")).alias("_off"))
    return found.withColumn("_val", F.when(F.col("_i").isNotNull(), _settled()))


_UNSETTLED = "_i IS NOT NULL AND _val IS NULL"


def _next_buckets(rows: DataFrame, found: DataFrame, path: list[str], digit: str, few: bool) -> tuple[DataFrame, DataFrame]:
    """The rows of unsettled buckets with their next digit, and the buckets of all ranks after it."""
    cells = found.where(_UNSETTLED).select(*path, F.col("_mn").alias("_lo"), F.col("_mx").alias("_hi")).distinct()
    rows = _matched(rows, F.broadcast(cells) if few else cells, path)
    # halves: the width of a bucket may exceed the largest double
    share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    rows = rows.withColumn(digit, F.floor(share * (STEPS - 1)) if digit == "_d1" else F.col("_v")).drop("_lo", "_hi")
    held = _buckets(rows, path, digit)
    before = found.select(*path, "_total", "_i", "_off", "_val")
    inside = F.expr(_UNSETTLED) & (F.col("_off") >= F.col("_before")) & (F.col("_off") < F.col("_before") + F.col("_n"))
    found = _matched(before, held, path, inside, "left")
    found = found.withColumn("_off", F.col("_off") - F.coalesce("_before", F.lit(0))).drop("_before")
    return rows, found.withColumn("_val", F.coalesce("_val", F.when(F.col("_i").isNotNull(), _settled())))


def _radix_quantiles(df, value, probs, groups, names):
    """Order statistics by three digits: leading bits, equal steps of a bucket, values."""
    spark, key = df.sparkSession, groups or ["_g"]
    rows = df.select(*groups, F.col(value).cast("double").alias("_v"))
    if not groups:
        rows = rows.withColumn("_g", F.lit(0))
    rows = rows.withColumn("_d0", leading_bits(F.col("_v")))
    found, path = _first_buckets(rows, key, probs), [*key, "_d0"]
    taken = found.limit(FEW + 1).toArrow()
    few = taken.num_rows <= FEW
    for digit in ("_d1", "_d2"):
        if few:
            found = spark.createDataFrame(taken, found.schema)
            if all(i is None or v is not None for i, v in zip(*(taken.column(c).to_pylist() for c in ("_i", "_val")))):
                break
        rows, found = _next_buckets(rows, found, path, digit, few)
        path = [*path, digit]
        if few:
            taken = found.toArrow()
    if few:  # settled ranks are at most FEW rows: a table of numbers, small enough for any join
        return F.broadcast(_from_settled(spark, taken, found.schema, probs, groups, names))
    picked = found.groupBy(*key).agg(F.max("_total").alias("_total"), *[
        F.max(F.when(F.col("_i") == k, F.col("_val"))).alias(f"_o{k}") for k in range(2 * len(probs))])
    outs = []
    for i, (p, n) in enumerate(zip(probs, names)):
        rank = (F.col("_total") - 1) * F.lit(p)
        low, high = F.col(f"_o{2 * i}"), F.col(f"_o{2 * i + 1}")
        outs.append((low + (high - low) * (rank - F.floor(rank))).alias(n))
    res = picked.select(*key, *outs)
    # without groups exactly one row, NULL for an empty input
    return res if groups else res.agg(*[F.max(n).alias(n) for n in names])


def _from_settled(spark, taken: pa.Table, schema: T.StructType, probs, groups, names) -> DataFrame:
    """The quantiles of groups whose settled ranks the driver holds; without groups exactly one row."""
    group = list(zip(*(map(repr, taken.column(g).to_pylist()) for g in groups))) if groups else [()] * taken.num_rows
    first, total, value = {}, {}, {}
    for row, (g, n, i, v) in enumerate(zip(group, *(taken.column(c).to_pylist() for c in ("_total", "_i", "_val")))):
        first.setdefault(g, row)
        total[g] = n
        if i is not None:
            value[g, i] = v
    if not groups:
        first.setdefault((), 0)
    columns = {g: taken.column(g).take(pa.array(list(first.values()), pa.int64())) for g in groups}
    for k, (p, name) in enumerate(zip(probs, names)):
        out = []
        for g in first:
            rank = (total.get(g, 0) - 1) * p
            low, high = value.get((g, 2 * k)), value.get((g, 2 * k + 1))
            out.append(None if low is None or high is None else low + (high - low) * (rank - math.floor(rank)))
        columns[name] = pa.array(out, pa.float64())
    fields = [schema[g] for g in groups] + [T.StructField(n, T.DoubleType()) for n in names]
    return spark.createDataFrame(pa.table(columns), T.StructType(fields))


def _sorted_quantiles(df, value, probs, groups, names):
    key = groups if groups else []
    v = (df.select(*key, F.col(value).cast("double").alias("_v"))
         .where(F.col("_v").isNotNull())
         .withColumn("_tb", F.monotonically_increasing_id()))
    if not key:
        v = v.withColumn("_g", F.lit(0))
        key = ["_g"]
    pos = with_group_position(v, key, ["_v", "_tb"], "_pos", "_n")
    n1 = F.col("_n") - 1
    keep = None
    aggs = [F.first("_n").alias("_n")]
    for i, p in enumerate(probs):
        rank = n1 * F.lit(p)
        lo, hi = F.floor(rank), F.ceil(rank)
        hit = (F.col("_pos") == lo) | (F.col("_pos") == hi)
        keep = hit if keep is None else (keep | hit)
        aggs.append(F.max(F.when(F.col("_pos") == lo, F.col("_v"))).alias(f"_lo{i}"))
        aggs.append(F.max(F.when(F.col("_pos") == hi, F.col("_v"))).alias(f"_hi{i}"))
    picked = pos.where(keep).groupBy(*key).agg(*aggs)
    outs = []
    for i, (p, n) in enumerate(zip(probs, names)):
        rank = (F.col("_n") - 1) * F.lit(p)
        frac = rank - F.floor(rank)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        outs.append((lo + (hi - lo) * frac).alias(n))
    res = picked.select(*key, *outs)
    if not groups:
        # exactly one row, NULL quantiles for an empty input
        return res.agg(*[F.max(n).alias(n) for n in names])
    # groups whose values are all NULL still appear (with NULL quantiles)
    all_groups = df.select(*groups).distinct()
    joined = all_groups.join(res, on=[all_groups[g].eqNullSafe(res[g]) for g in groups], how="left")
    return joined.select(*[all_groups[g] for g in groups], *[F.col(n) for n in names])


def scalar_quantile_frame(df: DataFrame, value: str, q: float, name: str = "cap",
                          method: str = "auto") -> DataFrame:
    """A one-row frame holding the quantile of the whole column (NULL when empty)."""
    return quantiles(df, value, [q], names=[name], method=method)
