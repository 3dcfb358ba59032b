"""op6: chat formatting of all conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmetrics.llm import chat
from postmetrics.llm.registry import register, table

HARD_TEXT = r"\### Assistant: </turn> ok"

SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev FROM c
), p AS (
  SELECT *, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS body,
         CASE WHEN prev = role THEN length('<next/>') + 1
              ELSE length('<turn:') + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
                   + 2 + length('</turn>') + 1 END AS head FROM o
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, text), '')) AS loss_sha256,
       sum(head + length(body))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""


@register("op6_chat_format", SQL)
def op6_chat_format(spark, sf_dir):
    """Every conversation formatted, then read back from the formatted text and its loss mask."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    out = chat.format_conversations(turns.unionByName(hard))
    out = out.withColumn("turns", chat.read_back(F.col("formatted"))) \
             .withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    per_turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(per_turn, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
