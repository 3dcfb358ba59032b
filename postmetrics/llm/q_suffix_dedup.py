"""op5: removal of repeated 400-byte strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmetrics.llm import suffix_dedup
from postmetrics.llm.registry import register, table


@register("op5_suffix_dedup")
def op5_suffix_dedup(spark, sf_dir):
    """What is left of every whole document (``text``, as the line and pipeline stages name it), with counts and digest."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"))
