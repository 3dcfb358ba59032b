"""Lookup, owner-inference and fixed-effects joins.

Group-level tables (latest row per key, entity means) are built with partial
aggregates - ``max_by`` keeps O(1) state per key - and joined back by key.
Join strategy is left to AQE (but in ``entity_demean``), which broadcasts a side only when its measured
runtime size is under the threshold and splits skewed partitions otherwise.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmetrics.functions.features import ci_equal
from postmetrics.operators.aggregates import mode_value


def latest_per_key(df: DataFrame, key: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Row with the greatest ``order`` tuple per key ("last wins"); O(1) state per key."""
    pick = F.max_by(F.struct(*[F.col(c) for c in keep]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(key).agg(pick.alias("_l")).select(key, *[F.col("_l")[c].alias(c) for c in keep])


def lookup_left(left: DataFrame, lookup: DataFrame, cond: Column) -> DataFrame:
    """Left join onto a deduplicated lookup: missing ids give NULL attributes."""
    return left.join(lookup, cond, "left")


def infer_owner(df: DataFrame, author: str, screen_name: str, reply_to: str,
                hint: str | None = None, required: bool = False) -> DataFrame:
    """Owner id: author matching the screen-name hint, else the modal author, else the
    modal reply target.  Each candidate is a one-row aggregate used as a scalar.

    Without any the owner is NULL (no reply is then one to the owner); with ``required`` reading it fails."""
    candidates = []
    if hint:
        matched = df.where(ci_equal(screen_name, F.lit(hint)))
        candidates.append(mode_value(matched, author, "o").scalar())
    candidates.append(mode_value(df, author, "o").scalar())
    candidates.append(mode_value(df, reply_to, "o").scalar())
    base = df.agg(F.count(F.lit(1)).alias("_n"))
    found = [c.cast("string") for c in candidates]
    if required:
        found.append(F.raise_error(F.lit("no owner can be inferred: no author and no reply target")).cast("string"))
    return base.select(F.coalesce(*found).alias("owner_id"))


def entity_demean(df: DataFrame, entity: str, cols: Sequence[str], add_grand_mean: bool = True) -> DataFrame:
    """Within transform: x - mean_entity(x) (+ grand mean of x)."""
    means = df.groupBy(entity).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    # the means of a task's entities are held in memory, its rows pass by; a sort would hold the rows
    out = df.join(means.hint("shuffle_hash"), entity)
    if add_grand_mean:  # all grand means from one aggregate
        out = out.withColumn("_grand", df.agg(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("g")).scalar())
    for c in cols:
        adj = F.col(c) - F.col(f"_m_{c}")
        out = out.withColumn(c, adj + F.col("_grand")[c] if add_grand_mean else adj)
    return out.drop("_grand", *[f"_m_{c}" for c in cols])
