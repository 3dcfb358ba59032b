"""op3: language-model scores of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmetrics.llm import context_tree
from postmetrics.llm.registry import register, table


def fold(id_column):
    return F.crc32(id_column.cast("string").cast("binary")) % 5


@register("op3_context_tree")
def op3_context_tree(spark, sf_dir):
    """Scores of every whole text under a model of the texts whose fold is not 1."""
    scored = context_tree.score(table(spark, sf_dir, "documents"), fold(F.col("id")) != 1)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score", "n_bytes")
