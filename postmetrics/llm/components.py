"""Connected components of a table of links.

Alternating large-star and small-star steps: each joins links with the smallest neighbour of a
vertex, so the table never grows beyond the links it began with and ends as one star per component.
Every step is an aggregation with partial sums and a join whose skewed keys Spark can split; each
step is a written table, and the rounds end when one count finds only stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmetrics.llm.staging import drop, stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: u and its neighbours above it (large star) or below it (small star) link to m, the
    smallest of u and its neighbours."""
    if large:  # a link is kept downwards; for what lies above u it is needed both ways
        links = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    pulled = links.join(links.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "u")
    moved = F.explode(F.array(F.struct(F.col("u").alias("x")), F.struct(F.col("v").alias("x"))))
    taken = pulled.select(moved.alias("t"), "u", "m").select(F.col("t.x").alias("x"), "u", "m")
    taken = taken.where("x >= u" if large else "x <= u")
    return taken.where("x > m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()


def _is_settled(links: DataFrame) -> bool:
    """True if every vertex has one link up and none down, or none up: one star per component."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not each.agg(F.max((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)))).first()[0]


def connected_components(links: DataFrame) -> DataFrame:
    """vertex, component (smallest vertex reachable) for every vertex of ``links`` (a, b).

    Self-links and links with a null end are ignored; an empty table gives no rows.
    """
    clean = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    current = stage(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _is_settled(current):
        large = stage(_star(current, True), "large_star")
        small = stage(_star(large, False), "small_star")
        drop(current, large)
        current = small
    return current.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
