"""The engineered post table: every per-post feature in one Spark plan.

``engineer_posts`` takes archive posts (canonical schema from ``sources.archive``
or any frame with the usual aliases) and returns the feature table; ``core_sample``
is the modelling subset.  All features are native Column expressions; the owner
id is a scalar subquery, the winsorizing cap a number; threads use pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmetrics.functions import features as fx
from postmetrics.functions.schema import has_column, resolve
from postmetrics.operators.aggregates import cap_column
from postmetrics.operators.joins import infer_owner

ID_ALIASES = ["id_str", "tweet.id_str", "id", "tweet.id"]
TIME_ALIASES = ["created_at", "tweet.created_at", "time", "date"]
TEXT_ALIASES = ["full_text", "text", "tweet.full_text", "tweet.text"]
REPLY_USER_ALIASES = ["in_reply_to_user_id_str", "tweet.in_reply_to_user_id_str",
                      "in_reply_to_user_id", "tweet.in_reply_to_user_id"]
SCREEN_NAME_ALIASES = ["user.screen_name", "user.screen_name_str", "screen_name"]
REPLY_STATUS_ALIASES = ["in_reply_to_status_id_str", "tweet.in_reply_to_status_id_str"]


def _opt(df, names):
    return resolve(df, names)


def _array(df, name, kind):
    """A list column by its path, bare or below ``tweet``, nested or with dots in its name."""
    for path in (name, f"tweet.{name}"):
        if has_column(df, path):
            return resolve(df, [path])
    return F.lit(None).cast(kind)


def _count(df, names):
    return fx.coerce_count(_opt(df, names))


def engineer_posts(df: DataFrame, owner_id: str | Column | None = None, screen_name_hint: str | None = None,
                   tz: str = "UTC", tier_start: str = fx.TIER_UPGRADED_START,
                   tier_end: str = fx.TIER_POST_UPGRADE_START, cap_q: float = fx.WINSORIZE_THRESHOLD,
                   threads: bool = True, keep: tuple = (), cap: bool = True) -> DataFrame:
    """Feature table over archive posts (one row per input row).

    With ``cap`` the table has ``winsorized_engagement``, whose cap takes a job here; without it, no
    job runs until the result is asked for (``with_cap`` adds the column later).
    """
    t_raw = resolve(df, TIME_ALIASES, endswith="created_at", required=True, what="timestamp")
    t_type = df.select(t_raw.alias("_t")).schema["_t"].dataType
    ts = t_raw.cast("timestamp") if isinstance(t_type, (T.TimestampType, T.TimestampNTZType)) else fx.parse_post_time(t_raw)
    text = F.coalesce(resolve(df, TEXT_ALIASES, contains="full_text").cast("string"), F.lit(""))
    reply_user = resolve(df, REPLY_USER_ALIASES).cast("string")
    media = _array(df, "extended_entities.media", "array<string>")
    hashtags = _array(df, "entities.hashtags", "array<string>")
    mentions = _array(df, "entities.user_mentions", "array<string>")
    urls = _array(df, "entities.urls", "array<struct<expanded_url:string>>")

    if owner_id is None:
        author = resolve(df, ["user.id_str", "user.id"]).cast("string")
        screen = resolve(df, SCREEN_NAME_ALIASES).cast("string")
        who = df.select(author.alias("a"), screen.alias("s"), reply_user.alias("r"))
        # without any author or reply target there is no reply whose type depends on the owner
        owner = infer_owner(who, "a", "s", "r", hint=screen_name_hint).scalar()
    else:
        owner = owner_id if isinstance(owner_id, Column) else F.lit(owner_id)

    base = df.select(
        *[F.col(c) for c in keep],
        resolve(df, ID_ALIASES, required=True, what="id").cast("string").alias("id_str"),
        fx.to_zone(ts, tz).alias("post_datetime"),
        fx.is_retweet(_opt(df, ["retweeted", "tweet.retweeted"]), _opt(df, ["retweeted_status", "tweet.retweeted_status"]),
                      text).alias("is_retweet"),
        fx.is_quote(_opt(df, ["is_quote_status", "tweet.is_quote_status"]),
                    _opt(df, ["quoted_status_id_str", "tweet.quoted_status_id_str"]), urls).alias("is_quote_tweet"),
        fx.has_link(text).alias("has_link"),
        fx.has_media(media).alias("has_media"),
        fx.text_length(text).alias("text_length_chars"),
        fx.entity_count(hashtags).alias("num_hashtags"),
        fx.entity_count(mentions).alias("num_mentions"),
        fx.has_question_mark(text).alias("has_question_mark"),
        reply_user.alias("in_reply_to_user_id_str"),
        resolve(df, REPLY_STATUS_ALIASES).cast("string").alias("in_reply_to_status_id_str"),
        fx.reply_type(reply_user, owner).alias("reply_type"),
        _count(df, ["favorite_count", "tweet.favorite_count"]).alias("likes"),
        _count(df, ["retweet_count", "tweet.retweet_count"]).alias("retweets"),
        _count(df, ["reply_count"]).alias("replies"),
        _count(df, ["bookmark_count"]).alias("bookmarks"),
    )
    out = base.select(
        "*",
        fx.weekday_name("post_datetime").alias("weekday"),
        fx.hour_of_day("post_datetime").alias("hour_of_day"),
        fx.month_label("post_datetime").alias("month"),
        fx.account_tier("post_datetime", tier_start, tier_end).alias("account_tier"),
        fx.total_engagement("likes", "retweets", "replies", "bookmarks").alias("total_engagement"),
    )
    if cap:
        out = with_cap(out, cap_q)
    if threads:
        from postmetrics.operators.threads import thread_features
        # of rows that share an id, the last one's parent counts
        rows = out.withColumn("_row", F.monotonically_increasing_id())
        out = thread_features(rows, "id_str", "in_reply_to_status_id_str", "post_datetime", ["_row"]).drop("thread_size", "_row")
    return out


def with_cap(eng: DataFrame, cap_q: float = fx.WINSORIZE_THRESHOLD) -> DataFrame:
    """``winsorized_engagement``: the total engagement capped at its quantile over all rows of ``eng``."""
    return cap_column(eng, "total_engagement", cap_q, "winsorized_engagement")


def core_sample(eng: DataFrame) -> DataFrame:
    """Modelling sample: no reposts, no quotes, replies only to others (or none)."""
    return eng.where(~F.col("is_retweet") & ~F.col("is_quote_tweet")
                     & F.col("reply_type").isin(fx.REPLY_NONE, fx.REPLY_OTHER))


def with_quotes_sample(eng: DataFrame) -> DataFrame:
    """The same sample with quote posts kept."""
    return eng.where(~F.col("is_retweet") & F.col("reply_type").isin(fx.REPLY_NONE, fx.REPLY_OTHER))
