"""op8: exact top-5 search over all embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmetrics.llm import mtree
from postmetrics.llm.registry import register, table

SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@register("op8_mtree", SQL)
def op8_mtree(spark, sf_dir):
    """The five best inner products of every query against all other rows."""
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5, 256)
