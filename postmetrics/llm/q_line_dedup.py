"""op7: cross-site boilerplate removal over all documents."""

from __future__ import annotations

from postmetrics.llm import line_dedup
from postmetrics.llm.registry import register, table

SQL = f"""
WITH l AS (
  SELECT rowid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM (SELECT row_number() OVER () AS rowid, coalesce(text, '') AS text FROM documents)
), o AS (SELECT row_number() OVER () AS rowid, doc_id, source, coalesce(text, '') AS text FROM documents
), b AS (
  SELECT trim(line) AS k FROM l JOIN o USING (rowid) WHERE trim(line) <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES} AND count(DISTINCT text) >= {line_dedup.MIN_SITES}
), m AS (
  SELECT l.*, trim(line) IN (SELECT k FROM b) AS gone FROM l
)
SELECT any_value(o.doc_id) AS doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_lines_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM m JOIN o USING (rowid) GROUP BY rowid
"""


@register("op7_line_dedup", SQL)
def op7_line_dedup(spark, sf_dir):
    """Every document after removal of lines that stand on many sites: line counts and digest of the kept text."""
    out = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.selectExpr("doc_id", "n_lines", "n_lines_removed", "md5(text) AS kept_md5")
