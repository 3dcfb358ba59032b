"""op11: repair of damaged conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmetrics.llm import repair
from postmetrics.llm.registry import register, table

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

# crc32 bit by bit; the states z, s, u, a hold the cheapest {cost, audit} that ends in them
SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(flatten(list_transform(string_split(key, ''),
         lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
         lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, 3988292384 * (x & 1)) END,
         4294967295::BIGINT), 4294967295::BIGINT) % 20 AS d FROM src
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE d <> 0)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged
), repeated AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS seen FROM numbered
), marked AS (
  SELECT *, left(role, 1) AS r,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM repeated
), paired AS (
  SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY k) || r AS pair FROM marked
), summary AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM paired GROUP BY conv_id
), solve AS (
  SELECT conv_id, 0::BIGINT AS k, {'c': 0::BIGINT, 'e': ''} AS z, {'c': 1000000000::BIGINT, 'e': ''} AS s,
         {'c': 1000000000::BIGINT, 'e': ''} AS u, {'c': 1000000000::BIGINT, 'e': ''} AS a FROM summary
  UNION ALL
  SELECT conv_id, k, {'c': z.c + 4, 'e': z.e || 'D'},
         CASE WHEN ok AND r = 's' THEN least({'c': s.c + 4, 'e': s.e || 'D'}, {'c': z.c + t, 'e': z.e || 'K'})
              ELSE {'c': s.c + 4, 'e': s.e || 'D'} END,
         CASE WHEN ok THEN least({'c': cu.c + 4, 'e': cu.e || 'D'},
                                 {'c': best.c + t + CASE WHEN r = 'u' THEN 0 ELSE 3 END, 'e': best.e || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END})
              ELSE {'c': cu.c + 4, 'e': cu.e || 'D'} END,
         CASE WHEN ok THEN least({'c': ca.c + 4, 'e': ca.e || 'D'},
                                 {'c': cu.c + t + CASE WHEN r = 'a' THEN 0 ELSE 3 END, 'e': cu.e || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END})
              ELSE {'c': ca.c + 4, 'e': ca.e || 'D'} END
  FROM (
    SELECT *, least(z, s, ca) AS best FROM (
      SELECT *, least(a, {'c': cu.c + 3, 'e': cu.e || 'I'}) AS ca FROM (
        SELECT v.conv_id, m.k, v.z, v.s, v.u, v.a, m.r, m.fault NOT IN ('b', 'd') AS ok, CASE WHEN m.fault = 't' THEN 3 ELSE 0 END AS t,
               least(v.u, {'c': v.z.c + 3, 'e': v.z.e || 'I'}, {'c': v.s.c + 3, 'e': v.s.e || 'I'}, {'c': v.a.c + 3, 'e': v.a.e || 'I'}) AS cu
        FROM solve v JOIN marked m ON v.conv_id IS NOT DISTINCT FROM m.conv_id AND m.k = v.k + 1)))
), solved AS (
  SELECT v.conv_id, least(v.z, v.a, {'c': v.u.c + 3, 'e': v.u.e || 'I'}) AS best
  FROM solve v JOIN summary y ON v.conv_id IS NOT DISTINCT FROM y.conv_id AND v.k = y.n
), edits AS (
  SELECT conv_id, unnest(string_split(best.e, '')) AS e, unnest(range(length(best.e))) AS p FROM solved WHERE best.e <> ''
), placed AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER w AS k, count(*) FILTER (e <> 'D') OVER w AS o FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), joined AS (
  SELECT p.*, m.role, m.text, m.r, max(CASE WHEN p.e = 'K' AND p.o = 1 AND m.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS has_s
  FROM placed p LEFT JOIN marked m ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND p.k = m.k AND p.e <> 'I' WHERE p.e <> 'D'
), written AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''),
                             chr(10) ORDER BY p) AS body FROM joined GROUP BY conv_id
)
SELECT c.conv_id, coalesce(y.gaps, 0)::BIGINT AS gaps, coalesce(y.blank, 0)::BIGINT AS blank, coalesce(y.duplicate, 0)::BIGINT AS duplicate,
       coalesce(y.truncated, 0)::BIGINT AS truncated, coalesce(y.illegal, 0)::BIGINT AS illegal, coalesce(v.best.c, 0)::BIGINT AS cost,
       coalesce(v.best.e, '') AS audit, sha256(coalesce(w.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN summary y ON c.conv_id IS NOT DISTINCT FROM y.conv_id
LEFT JOIN solved v ON c.conv_id IS NOT DISTINCT FROM v.conv_id
LEFT JOIN written w ON c.conv_id IS NOT DISTINCT FROM w.conv_id
"""


def damage(turns: DataFrame) -> DataFrame:
    """Rows dropped, emptied, stripped of sentence ends, repeated or given to the user, by a hash of their place."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
                        (F.crc32(key.cast("binary")) % 20).alias("d")).where("d <> 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("d") == 3, 2).otherwise(1))))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op11(turns: DataFrame) -> DataFrame:
    """The repair report of damaged ``turns``, a row for every original conversation."""
    report = repair.repair_report(damage(turns))
    ids = turns.select(F.col("conv_id").alias("own_id")).distinct()
    joined = ids.join(report, F.col("own_id").eqNullSafe(F.col("conv_id")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(F.col("own_id").alias("conv_id"), *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers],
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))


@register("op11_repair", SQL)
def op11_repair(spark, sf_dir):
    """All conversations, damaged and repaired."""
    return op11(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
