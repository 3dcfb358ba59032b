"""Thread queries.

Threads over ``events``: a 'view' or 'click' event replies to the same user's
previous event (by time, then id); other events start threads.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postmetrics.operators.threads import previous_in_group, thread_features, thread_roots, thread_sizes
from postmetrics.plans.registry import register
from postmetrics.sources.tables import table

SQL_THREADS = """
WITH RECURSIVE e AS (
  SELECT event_id, user_id, ts, event_type,
         LAG(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
edges AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(prev AS VARCHAR) AS parent
          FROM e WHERE event_type IN ('view', 'click') AND prev IS NOT NULL),
walk(start_id, cur, depth) AS (
  SELECT CAST(event_id AS VARCHAR), CAST(event_id AS VARCHAR), 0 FROM events
  UNION ALL
  SELECT w.start_id, g.parent, w.depth + 1 FROM walk w JOIN edges g ON g.id = w.cur),
roots AS (SELECT start_id, arg_max(cur, depth) AS thread_id FROM walk GROUP BY start_id),
t AS (
  SELECT ev.event_id AS post_id, r.thread_id, ev.ts,
    CAST(ROW_NUMBER() OVER (PARTITION BY r.thread_id ORDER BY ev.ts ASC NULLS LAST, ev.event_id) - 1 AS INTEGER) AS thread_step_index,
    count(*) OVER (PARTITION BY r.thread_id) AS thread_size
  FROM events ev JOIN roots r ON CAST(ev.event_id AS VARCHAR) = r.start_id)"""


def event_replies(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
                                          "event_type")
    prev = previous_in_group(ev, "user_id", [F.col("ts"), F.col("event_id")], ["event_id"])
    return prev.withColumn("parent", F.when(F.col("event_type").isin("view", "click"), F.col("prev_event_id")))


def event_threads(spark, d):
    return thread_features(event_replies(spark, d), "event_id", "parent", "ts")


@register("join_thread_roots", SQL_THREADS + " SELECT post_id, thread_id FROM t")
def join_thread_roots(spark, d):
    r = thread_roots(event_replies(spark, d), "event_id", "parent")
    return r.select(F.col("id").cast("bigint").alias("post_id"), "thread_id")


@register("win_thread_step", SQL_THREADS + """
SELECT post_id, thread_id, thread_step_index, thread_step_index = 0 AS is_thread_starter FROM t""")
def win_thread_step(spark, d):
    t = event_threads(spark, d)
    return t.select(F.col("event_id").alias("post_id"), "thread_id", "thread_step_index", "is_thread_starter")


@register("win_group_size", SQL_THREADS + " SELECT post_id, thread_size FROM t")
def win_group_size(spark, d):
    t = thread_sizes(event_replies(spark, d), "event_id", "parent")
    return t.select(F.col("event_id").alias("post_id"), "thread_size")


@register("filt_multi_member", SQL_THREADS + " SELECT post_id, thread_id FROM t WHERE thread_size > 1")
def filt_multi_member(spark, d):
    t = thread_sizes(event_replies(spark, d), "event_id", "parent")
    return t.where(F.col("thread_size") > 1).select(F.col("event_id").alias("post_id"), "thread_id")
