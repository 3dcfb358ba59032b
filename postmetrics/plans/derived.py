"""The engineered post table built from the driver's ``events`` table.

``events`` carries no archive flags, so archive-shaped inputs are derived from
its columns deterministically (and identically in the SQL oracle):

* reply target   = for 'view' and 'click' events (NULL otherwise) the user numbered
                   k % 5 before the author, and the event 1 + k % 3 before this one
                   (no event for k in 60..64);
* retweet inputs = flag TRUE for k < 5, FALSE for k > 90, a retweeted-status
                   struct for k in 5..9, 'RT @' text for k in 10..14;
* quote inputs   = flag TRUE for k in 15..19, FALSE for k in 85..89, a quoted
                   id for k in 20..24, a status url for k in 25..29 and a
                   non-status url for k in 30..34;
* counts         = likes from the value (text, coerced), retweets from k (text).

Tier boundaries for the 30-day table are 2024-01-11 and 2024-01-21.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmetrics.operators.aggregates import mode_value
from postmetrics.operators.engineer import core_sample as _core_sample
from postmetrics.operators.engineer import engineer_posts
from postmetrics.operators.ordinal import with_previous
from postmetrics.sources.tables import posts

EVENT_TIER_A = "2024-01-11"
EVENT_TIER_B = "2024-01-21"


def previous_in_time(df: DataFrame, ts: str, key: str, cols: list[str], prefix: str = "prev_") -> DataFrame:
    """Attach columns of the previous row in the global (ts, key) order.

    A global ``lag`` would need one task; ``ordinal.with_previous`` does it per range
    partition with a bounded border table.
    """
    return with_previous(df, [F.col(ts), F.col(key)], cols, prefix)


def archive_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir, parse_once=True)
    k = F.col("k")
    replying = F.col("category").isin("view", "click")
    url = (F.when(k.between(25, 29), F.concat(F.lit("https://twitter.com/u/status/"), F.col("post_id").cast("string")))
           .when(k.between(30, 34), F.concat(F.lit("https://example.com/p/"), F.col("post_id").cast("string"))))
    return p.select(
        "post_id", "author_id", "post_datetime", "category", "engagement", "k",
        F.col("post_id").cast("string").alias("id_str"),
        F.when(replying, (F.col("author_id") - k % 5).cast("string")).alias("in_reply_to_user_id_str"),
        F.when(replying & ~k.between(60, 64), (F.col("post_id") - 1 - k % 3).cast("string"))
         .alias("in_reply_to_status_id_str"),
        F.when(k < 5, F.lit(True)).when(k > 90, F.lit(False)).alias("retweeted"),
        F.when(k.between(5, 9), F.struct(F.col("post_id").cast("string").alias("id_str")))
         .alias("retweeted_status"),
        F.when(k.between(10, 14), F.concat(F.lit("RT @user"), F.col("author_id").cast("string")))
         .otherwise(F.col("category")).alias("full_text"),
        F.when(k.between(15, 19), F.lit(True)).when(k.between(85, 89), F.lit(False)).alias("is_quote_status"),
        F.when(k.between(20, 24), (F.col("post_id") + 1).cast("string")).alias("quoted_status_id_str"),
        F.when(url.isNotNull(), F.array(F.struct(url.alias("expanded_url")))).alias("urls"),
        F.col("engagement").cast("string").alias("favorite_count"),
        F.col("k").cast("string").alias("retweet_count"),
    )


def engineered(spark: SparkSession, sf_dir: str, entities: bool = False, cap: bool = False) -> DataFrame:
    """Engineered post table over ``events``: the archive-shaped inputs go through the
    general ``engineer_posts``; the owner is the modal author (ties: smallest id).
    With ``entities``, posts get links in their texts, media, hashtags and mentions by ranges of k.
    With ``cap`` there is also the capped engagement (one job while the frame is made)."""
    a = archive_inputs(spark, sf_dir)
    modal = mode_value(posts(spark, sf_dir), "author_id", "owner_id").select(F.col("owner_id").cast("string"))
    # with a cap a job runs here anyway: the owner is then a literal too, read once for all later plans
    owner = F.lit(modal.first()["owner_id"]).cast("string") if cap else modal.scalar()
    posts_like = a.select(
        "post_id", "author_id", "category", "engagement", "k", "id_str",
        F.col("post_datetime").alias("created_at"), "full_text", "retweeted", "retweeted_status",
        "is_quote_status", "quoted_status_id_str", F.struct(F.col("urls").alias("urls")).alias("entities"),
        "in_reply_to_user_id_str", "in_reply_to_status_id_str", "favorite_count", "retweet_count")
    if entities:
        posts_like = _with_entities(posts_like)
    e = engineer_posts(posts_like, owner_id=owner, tier_start=EVENT_TIER_A, tier_end=EVENT_TIER_B,
                       threads=False, keep=("post_id", "author_id", "category", "engagement", "k"), cap=cap)
    return e


def _with_entities(posts_like: DataFrame) -> DataFrame:
    """A short link for k in 30..49, a picture for k in 45..64, k % 4 hashtags and k % 3 mentions (k known)."""
    k = F.col("k")
    link = F.when(k.between(30, 49), F.concat(F.lit(" https://t.co/"), F.col("id_str"))).otherwise("")

    def names(n):
        return F.coalesce(F.array_repeat(F.lit("name"), n.cast("int")), F.array().cast("array<string>"))
    return posts_like.withColumns({
        "full_text": F.concat(F.col("full_text"), link),
        "extended_entities": F.struct(F.when(k.between(45, 64), F.array(F.lit("photo"))).alias("media")),
        "entities": F.struct(F.col("entities.urls").alias("urls"), names(F.pmod(k, F.lit(4))).alias("hashtags"),
                             names(F.pmod(k, F.lit(3))).alias("user_mentions"))})


def core_sample(eng: DataFrame) -> DataFrame:
    return _core_sample(eng)


# The same derivation in DuckDB SQL (CTE list; the final CTE is ``eng``).
SQL_ENGINEERED = """
p0 AS (
  SELECT event_id AS post_id, user_id AS author_id, ts AS post_datetime, event_type AS category,
         value AS engagement, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
owner AS (
  SELECT CAST(author_id AS VARCHAR) AS owner_id FROM (
    SELECT author_id, count(*) AS n FROM p0 WHERE author_id IS NOT NULL GROUP BY author_id
    ORDER BY n DESC, author_id LIMIT 1)),
a AS (
  SELECT *,
    CASE WHEN category IN ('view', 'click') THEN CAST(author_id - k % 5 AS VARCHAR) END AS reply_to,
    CASE WHEN category IN ('view', 'click') AND NOT k BETWEEN 60 AND 64 THEN CAST(post_id - 1 - k % 3 AS VARCHAR) END AS reply_status,
    CASE WHEN k < 5 THEN TRUE WHEN k > 90 THEN FALSE END AS rt_flag,
    (k BETWEEN 5 AND 9) AS rt_struct,
    CASE WHEN k BETWEEN 10 AND 14 THEN 'RT @user' || CAST(author_id AS VARCHAR) ELSE category END AS full_text,
    CASE WHEN k BETWEEN 15 AND 19 THEN TRUE WHEN k BETWEEN 85 AND 89 THEN FALSE END AS q_flag,
    (k BETWEEN 20 AND 24) AS q_id,
    (k BETWEEN 25 AND 29) AS q_url
  FROM p0),
e0 AS (
  SELECT post_id, CAST(post_id AS VARCHAR) AS id_str, author_id, post_datetime, category, engagement, k,
    reply_to AS in_reply_to_user_id_str, reply_status AS in_reply_to_status_id_str,
    COALESCE(rt_flag, CASE WHEN rt_struct THEN TRUE END, starts_with(COALESCE(full_text, ''), 'RT @')) AS is_retweet,
    COALESCE(q_flag, CASE WHEN q_id THEN TRUE END, CASE WHEN q_url THEN TRUE END, FALSE) AS is_quote_tweet,
    CASE WHEN reply_to IS NULL THEN 'none'
         WHEN (SELECT owner_id FROM owner) IS NOT NULL AND (SELECT owner_id FROM owner) <> ''
              AND reply_to = (SELECT owner_id FROM owner) THEN 'reply_own'
         ELSE 'reply_other' END AS reply_type,
    dayname(post_datetime) AS weekday,
    CAST(hour(post_datetime) AS INTEGER) AS hour_of_day,
    strftime(post_datetime, '%Y-%m') AS month,
    CASE WHEN post_datetime < TIMESTAMP '2024-01-11' THEN 'tier_pre_upgrade'
         WHEN post_datetime >= TIMESTAMP '2024-01-11' AND post_datetime <= TIMESTAMP '2024-01-21' THEN 'tier_upgraded'
         ELSE 'tier_post_upgrade' END AS account_tier,
    COALESCE(CAST(trunc(TRY_CAST(CAST(engagement AS VARCHAR) AS DOUBLE)) AS BIGINT), 0) AS likes,
    COALESCE(CAST(trunc(TRY_CAST(CAST(k AS VARCHAR) AS DOUBLE)) AS BIGINT), 0) AS retweets,
    CAST(0 AS BIGINT) AS replies, CAST(0 AS BIGINT) AS bookmarks
  FROM a),
e1 AS (SELECT *, likes + retweets + replies + bookmarks AS total_engagement FROM e0),
eng AS (
  SELECT *, CASE WHEN total_engagement > (SELECT quantile_cont(total_engagement, 0.95) FROM e1) THEN (SELECT quantile_cont(total_engagement, 0.95) FROM e1) ELSE total_engagement END AS winsorized_engagement
  FROM e1)"""

SQL_CORE = "core AS (SELECT * FROM eng WHERE NOT is_retweet AND NOT is_quote_tweet AND reply_type IN ('none', 'reply_other'))"
