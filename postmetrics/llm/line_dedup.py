"""Removal of lines that stand on many sites.

A line (space-trimmed, blank ones aside) is boilerplate when it stands on at least ``min_sites``
distinct sites and in at least as many distinct texts; the second condition leaves copies of one
document alone.  Both spreads are HyperLogLog sketches per line hash, merged by aggregation; lines
whose estimate is near the threshold get exact distinct counts.  A line that occurs fewer times than
the threshold cannot pass, so only the others are sketched.

Defined results: every occurrence of a boilerplate line goes; a document keeps its other lines in
order, and stays even if none is left; a null text counts as empty, a null site as no site; rows
with equal id and text share one result, whatever the id (null included); other columns pass through,
but for any already named like the two counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmetrics.llm.staging import stage

MIN_SITES = 10
SKETCH_LG_K = 12
#: Relative half-width of the band around the threshold that is counted exactly (5 standard errors).
NEAR = 0.08


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _lines(docs: DataFrame, site_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(site_col).cast("string").alias("site"), F.xxhash64(text).alias("doc_text"),
                       F.explode(F.split(text, "\n")).alias("line"))
    return rows.where(F.trim("line") != "").select(line_key(F.col("line")).alias("line_key"), "site", "doc_text")


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """line_key of every line that spreads over at least ``min_sites`` sites and texts (staged)."""
    lines = _lines(docs, site_col, text_col)
    often = stage(lines.groupBy("line_key").count().where(F.col("count") >= min_sites).select("line_key"), "frequent_lines")
    seen = lines.join(often, "line_key", "left_semi")
    spread = stage(seen.groupBy("line_key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_LG_K)).alias("sites"),
        F.hll_sketch_estimate(F.hll_sketch_agg("doc_text", SKETCH_LG_K)).alias("texts")), "line_spread")
    least = F.least("sites", "texts")
    margin = max(1.0, NEAR * min_sites)
    clear = spread.where(least > min_sites + margin).select("line_key")
    near = spread.where(F.abs(least - F.lit(min_sites)) <= margin).select("line_key")
    # one distinct count at a time: each is a plain two-step aggregation
    exact = lines.join(near, "line_key", "left_semi")
    by_site = exact.select("line_key", "site").where("site IS NOT NULL").distinct().groupBy("line_key").count()
    by_text = exact.select("line_key", "doc_text").distinct().groupBy("line_key").count()
    passed = by_site.where(F.col("count") >= min_sites).select("line_key").join(
        by_text.where(F.col("count") >= min_sites).select("line_key"), "line_key", "left_semi")
    return stage(clear.unionByName(passed), "boilerplate_lines")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", site_col: str = "source",
                       text_col: str = "text") -> DataFrame:
    """``docs`` with the boilerplate lines gone from its text, plus n_lines and n_lines_removed."""
    gone = boilerplate_lines(docs, min_sites, site_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    hits = (docs.select(F.col(id_col).alias("hit_id"), F.xxhash64(text).alias("hit_text"), F.explode(F.split(text, "\n")).alias("line"))
            .select("hit_id", "hit_text", line_key(F.col("line")).alias("line_key"))
            .join(gone, "line_key", "left_semi")
            .groupBy("hit_id", "hit_text").agg(F.collect_set("line_key").alias("gone")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("own_id"), text.alias("whole"), F.xxhash64(text).alias("own_text"))
    joined = rows.join(hits, F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_text") == F.col("hit_text")), "left")
    lines = F.split("whole", "\n")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("gone", line_key(x)))
    cleaned = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size(lines) - F.size(kept))
    counts = {"n_lines": F.size(lines).cast("long"), "n_lines_removed": removed.cast("long")}
    columns = [cleaned.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in counts]
    return joined.select(*columns, *[v.alias(k) for k, v in counts.items()])
