"""op10: near-duplicate embeddings."""

from __future__ import annotations

from postmetrics.llm import projections
from postmetrics.llm.registry import register, table

SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS id, vec_id AS c FROM v
  UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id
)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a = v.vec_id)::BIGINT AS n_links,
       min(r.c) AS component_id, min(r.c) = v.vec_id AS kept
FROM v JOIN r ON r.id = v.vec_id GROUP BY v.vec_id
"""


@register("op10_projections", SQL)
def op10_projections(spark, sf_dir):
    """Links at cosine 0.9 or more between all embeddings: number, component, kept."""
    return projections.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)
