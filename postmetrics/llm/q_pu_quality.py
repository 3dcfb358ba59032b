"""op4: quality scores of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmetrics.llm import pu_quality
from postmetrics.llm.registry import register, table

THRESHOLD = 0.7


def fold(id_column):
    return F.crc32(id_column.cast("string").cast("binary")) % 4


@register("op4_pu_quality")
def op4_pu_quality(spark, sf_dir):
    """Score of every whole text; labels are read only where the fold is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = pu_quality.train(docs, table(spark, sf_dir, "labels"), fold(F.col("id")) != 2)
    return pu_quality.score(docs, model).select(
        "doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
