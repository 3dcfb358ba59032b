"""op13: toxicity scores of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmetrics.llm import toxicity
from postmetrics.llm.registry import register, table

THRESHOLD = 0.7


def fold(id_column):
    return F.crc32(id_column.cast("string").cast("binary")) % 3


@register("op13_toxicity")
def op13_toxicity(spark, sf_dir):
    """Score of every whole text; labels are read only where the fold is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("id")) != 1)
    return toxicity.score(docs, model).select(
        "doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
