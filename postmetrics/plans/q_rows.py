"""Projection, filter, window, sort, set and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmetrics.functions import features as fx
from postmetrics.functions.schema import resolve
from postmetrics.operators import aggregates as ag
from postmetrics.operators import network as nw
from postmetrics.operators import strata as st
from postmetrics.operators.ordinal import with_global_index
from postmetrics.plans.derived import SQL_CORE, SQL_ENGINEERED, archive_inputs, core_sample, engineered
from postmetrics.plans.q_aggregates import (SQL_CAPPED, SQL_CATEGORY_STATS, SQL_ORDERS_REL, capped_events,
                                            event_study, monthly)
from postmetrics.plans.registry import r6, register, ts_text
from postmetrics.sources.tables import posts, table

SQL_ENG = "WITH " + SQL_ENGINEERED + " "
SQL_ENG_CORE = "WITH " + SQL_ENGINEERED + ", " + SQL_CORE + " "
WS_SQL = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# ---------------------------------------------------------------- projections


@register("proj_alias_resolve", """
SELECT CAST(event_id AS VARCHAR) AS id_str, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS post_datetime,
       event_type || ' by ' || CAST(user_id AS VARCHAR) AS text FROM events""")
def proj_alias_resolve(spark, d):
    """Aliases of every kind: plain, dotted inside a struct, and a name that holds a dot."""
    ev = table(spark, d, "events").withColumn("tweet.full_text", F.concat(
        F.col("event_type"), F.lit(" by "), F.col("user_id").cast("string")))
    pid = resolve(ev, ["id_str", "tweet.id_str", "id", "tweet.id", "event_id"], required=True, what="id")
    t = resolve(ev, ["created_at", "tweet.created_at", "time", "date", "ts"], endswith="created_at", required=True)
    text = resolve(ev, ["full_text", "text", "tweet.full_text", "tweet.text"], contains="full_text")
    return ev.select(pid.cast("string").alias("id_str"), ts_text(t.cast("timestamp")).alias("post_datetime"),
                     text.cast("string").alias("text"))


@register("proj_post_datetime", """
SELECT event_id AS post_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') AS archive_dt,
       strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS iso_dt, CAST(NULL AS VARCHAR) AS bad_dt FROM events""")
def proj_post_datetime(spark, d):
    ev = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    archive_text = F.date_format("ts", fx.ARCHIVE_TIME_WRITE_FORMAT)
    iso_text = F.col("ts").cast("string")
    return ev.select(F.col("event_id").alias("post_id"),
                     ts_text(fx.parse_post_time(archive_text)).alias("archive_dt"),
                     ts_text(fx.parse_post_time(iso_text)).alias("iso_dt"),
                     ts_text(fx.parse_post_time(F.concat(F.lit("not a date "), iso_text))).alias("bad_dt"))


@register("proj_string_id", """
SELECT CAST(event_id AS VARCHAR) AS id_str, CAST(user_id AS VARCHAR) AS user_id_str FROM events""")
def proj_string_id(spark, d):
    ev = table(spark, d, "events")
    return ev.select(F.col("event_id").cast("string").alias("id_str"), F.col("user_id").cast("string").alias("user_id_str"))


SQL_COUNTS = """
WITH c AS (
  SELECT event_id AS post_id,
    COALESCE(CAST(trunc(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE)) AS BIGINT), 0) AS likes,
    COALESCE(CAST(trunc(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS BIGINT), 0) AS retweets,
    COALESCE(TRY_CAST(trunc(TRY_CAST(CASE WHEN k % 10 = 0 THEN 'NaN' WHEN k % 10 = 1 THEN '1e30' WHEN k % 10 = 2 THEN '-Infinity'
      WHEN k % 10 = 3 THEN 'many' WHEN k % 10 = 4 THEN NULL ELSE CAST(k AS VARCHAR) || '.75' END AS DOUBLE)) AS BIGINT), 0) AS replies,
    CAST(0 AS BIGINT) AS bookmarks
  FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def _counts(spark, d):
    ev = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    odd = (F.when(k % 10 == 0, "NaN").when(k % 10 == 1, "1e30").when(k % 10 == 2, "-Infinity").when(k % 10 == 3, "many")
           .when(k % 10 == 4, F.lit(None)).otherwise(F.concat(k.cast("string"), F.lit(".75"))))
    return ev.select(F.col("event_id").alias("post_id"),
                     fx.coerce_count(F.col("value").cast("string")).alias("likes"),
                     fx.coerce_count(F.get_json_object("props", "$.k")).alias("retweets"),
                     fx.coerce_count(odd).alias("replies"),
                     fx.coerce_count(F.lit(None).cast("string")).alias("bookmarks"))


@register("proj_counts", SQL_COUNTS + " SELECT * FROM c")
def proj_counts(spark, d):
    return _counts(spark, d)


@register("proj_total_engagement", SQL_COUNTS + """
SELECT post_id, likes + retweets + replies + bookmarks AS total_engagement FROM c""")
def proj_total_engagement(spark, d):
    c = _counts(spark, d)
    return c.select("post_id", fx.total_engagement("likes", "retweets", "replies", "bookmarks").alias("total_engagement"))


@register("proj_weighted_engagement", SQL_COUNTS + """
SELECT post_id, likes + 10 * retweets AS weighted_engagement FROM c""")
def proj_weighted_engagement(spark, d):
    c = _counts(spark, d)
    return c.select("post_id", fx.weighted_engagement("likes", "retweets").alias("weighted_engagement"))


@register("proj_is_retweet", SQL_ENG + "SELECT post_id, is_retweet FROM eng")
def proj_is_retweet(spark, d):
    a = archive_inputs(spark, d)
    return a.select("post_id", fx.is_retweet("retweeted", "retweeted_status", "full_text").alias("is_retweet"))


@register("proj_is_quote", SQL_ENG + "SELECT post_id, is_quote_tweet FROM eng")
def proj_is_quote(spark, d):
    a = archive_inputs(spark, d)
    return a.select("post_id", fx.is_quote("is_quote_status", "quoted_status_id_str", "urls").alias("is_quote_tweet"))


@register("proj_reply_type", SQL_ENG + "SELECT post_id, reply_type FROM eng")
def proj_reply_type(spark, d):
    return engineered(spark, d).select("post_id", "reply_type")


@register("proj_is_reply", SQL_ENG + "SELECT post_id, in_reply_to_status_id_str IS NOT NULL AS is_reply FROM eng")
def proj_is_reply(spark, d):
    a = archive_inputs(spark, d)
    return a.select("post_id", fx.is_reply("in_reply_to_status_id_str").alias("is_reply"))


SQL_HAS_LINK = """
SELECT page_id, 'page' AS input, regexp_matches(COALESCE(html, ''), 'https://t.co/') AS has_link FROM pages
UNION ALL
SELECT page_id, 'link added', regexp_matches(COALESCE(html || ' https://t.co/x', ''), 'https://t.co/') FROM pages
UNION ALL
SELECT page_id, 'no text', FALSE FROM pages"""


@register("proj_has_link", SQL_HAS_LINK)
@register("proj_has_link_whole", SQL_HAS_LINK)
def proj_has_link(spark, d):
    """Every page by its whole text; beside it one row with a short link added and one without text."""
    pg = table(spark, d, "pages")
    texts = {"page": F.col("html"), "link added": F.concat("html", F.lit(" https://t.co/x")), "no text": F.lit(None).cast("string")}
    return _beside(pg, texts).select("page_id", "input", fx.has_link("value").alias("has_link"))


SQL_HAS_MEDIA = """
SELECT page_id, 'page' AS input, COALESCE(len(regexp_extract_all(html, '<h1[^>]*>')) > 0, FALSE) AS has_media FROM pages
UNION ALL
SELECT page_id, 'emptied', FALSE FROM pages
UNION ALL
SELECT page_id, 'no media', FALSE FROM pages"""


@register("proj_has_media", SQL_HAS_MEDIA)
@register("proj_has_media_whole", SQL_HAS_MEDIA)
def proj_has_media(spark, d):
    """Every page by its whole list; beside it one row with an empty list and one without a list."""
    pg = table(spark, d, "pages")
    lists = {"page": F.regexp_extract_all("html", F.lit("<h1[^>]*>"), 0), "emptied": F.array().cast("array<string>"),
             "no media": F.lit(None).cast("array<string>")}
    return _beside(pg, lists).select("page_id", "input", fx.has_media("value").alias("has_media"))


def _beside(pg, values):
    """One row for each page and named value, in one scan."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("input"), v.alias("value")) for name, v in values.items()]))
    return pg.select("page_id", rows.alias("r")).select("page_id", "r.input", "r.value")


@register("proj_question_mark", """
SELECT page_id, contains(COALESCE(url, ''), '?') AS has_question_mark FROM pages""")
def proj_question_mark(spark, d):
    return table(spark, d, "pages").select("page_id", fx.has_question_mark("url").alias("has_question_mark"))


@register("proj_entity_counts", r"""
SELECT doc_id,
  CAST(COALESCE(len(CASE WHEN contains(text, '#') THEN regexp_extract_all(text, '#[^ \t\n\r#]*') END), 0) AS INTEGER) AS num_hashtags,
  CAST(COALESCE(len(CASE WHEN contains(text, '@') THEN regexp_extract_all(text, '@[^ \t\n\r@]*') END), 0) AS INTEGER) AS num_mentions
FROM documents""")
def proj_entity_counts(spark, d):
    docs = table(spark, d, "documents")
    tags = F.when(F.col("text").contains("#"), F.regexp_extract_all("text", F.lit(r"#[^ \t\n\r#]*"), 0))
    ments = F.when(F.col("text").contains("@"), F.regexp_extract_all("text", F.lit(r"@[^ \t\n\r@]*"), 0))
    return docs.select("doc_id", fx.entity_count(tags).alias("num_hashtags"), fx.entity_count(ments).alias("num_mentions"))


@register("proj_text_length", """
SELECT doc_id, CAST(length(COALESCE(text, '')) AS INTEGER) AS text_length_chars FROM documents""")
def proj_text_length(spark, d):
    return table(spark, d, "documents").select("doc_id", fx.text_length("text").alias("text_length_chars"))


@register("proj_time_parts", """
SELECT event_id AS post_id, dayname(ts) AS weekday, CAST(hour(ts) AS INTEGER) AS hour_of_day,
       strftime(ts, '%Y-%m') AS month FROM events""")
def proj_time_parts(spark, d):
    p = posts(spark, d)
    return p.select("post_id", fx.weekday_name("post_datetime").alias("weekday"),
                    fx.hour_of_day("post_datetime").alias("hour_of_day"), fx.month_label("post_datetime").alias("month"))


@register("proj_week_period", """
SELECT event_id AS post_id,
  strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS week
FROM events""")
def proj_week_period(spark, d):
    p = posts(spark, d)
    return p.select("post_id", fx.week_period("post_datetime").alias("week"))


@register("proj_relative_week", """
SELECT o_orderkey,
  CAST(floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-01-01')) / 604800000000.0) AS INTEGER) AS rel_week_a,
  CAST(floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '2000-01-01')) / 604800000000.0) AS INTEGER) AS rel_week_b
FROM orders""")
def proj_relative_week(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    return o.select("o_orderkey",
                    fx.relative_week("ts", F.to_timestamp(F.lit("1998-01-01"))).alias("rel_week_a"),
                    fx.relative_week("ts", F.to_timestamp(F.lit("2000-01-01"))).alias("rel_week_b"))


@register("proj_tier", SQL_ENG + "SELECT post_id, account_tier FROM eng")
def proj_tier(spark, d):
    from postmetrics.plans.derived import EVENT_TIER_A, EVENT_TIER_B
    p = posts(spark, d)
    return p.select("post_id", fx.account_tier("post_datetime", EVENT_TIER_A, EVENT_TIER_B).alias("account_tier"))


@register("proj_winsorize", "WITH " + SQL_CAPPED + " SELECT post_id, round_even(winsorized, 6) AS winsorized FROM capped")
def proj_winsorize(spark, d):
    return capped_events(spark, d).select("post_id", r6("winsorized").alias("winsorized"))


@register("proj_log1p_exp", "WITH " + SQL_CAPPED + """
SELECT post_id, round_even(ln(1 + winsorized), 6) AS log1p_winsorized, round_even(exp(ln(1 + winsorized)), 6) AS exp_back
FROM capped""")
def proj_log1p_exp(spark, d):
    c = capped_events(spark, d).select("post_id", F.log1p("winsorized").alias("y"))
    return c.select("post_id", r6("y").alias("log1p_winsorized"), r6(F.exp("y")).alias("exp_back"))


@register("proj_head_columns", SQL_ENG_CORE + """
SELECT post_id, reply_type, account_tier, total_engagement FROM core ORDER BY post_datetime, post_id LIMIT 5""")
def proj_head_columns(spark, d):
    c = core_sample(engineered(spark, d))
    return c.orderBy("post_datetime", "post_id").select("post_id", "reply_type", "account_tier", "total_engagement").limit(5)

# ---------------------------------------------------------------- filters


@register("filt_core_sample", SQL_ENG_CORE + "SELECT post_id FROM core")
def filt_core_sample(spark, d):
    return core_sample(engineered(spark, d)).select("post_id")


@register("filt_with_quotes", SQL_ENG + """
SELECT post_id, is_quote_tweet FROM eng WHERE NOT is_retweet AND reply_type IN ('none', 'reply_other')""")
def filt_with_quotes(spark, d):
    e = engineered(spark, d)
    return e.where(~F.col("is_retweet") & F.col("reply_type").isin(fx.REPLY_NONE, fx.REPLY_OTHER)).select(
        "post_id", "is_quote_tweet")


@register("filt_min_length", f"""
SELECT doc_id,
  length(regexp_replace(COALESCE(text, ''), '^{WS_SQL}+|{WS_SQL}+$', '', 'g')) > 20 AS longer_than_20
FROM documents WHERE length(regexp_replace(COALESCE(text, ''), '^{WS_SQL}+|{WS_SQL}+$', '', 'g')) > 15""")
def filt_min_length(spark, d):
    docs = table(spark, d, "documents").select("doc_id", fx.stripped_length("text").alias("_len"))
    return docs.where(F.col("_len") > 15).select("doc_id", (F.col("_len") > 20).alias("longer_than_20"))


@register("filt_event_window", SQL_ORDERS_REL + " SELECT o_orderkey, rel_week FROM c WHERE rel_week BETWEEN -12 AND 12")
def filt_event_window(spark, d):
    from postmetrics.plans.q_aggregates import orders_relative
    o = orders_relative(spark, d)
    return o.where(fx.relative_week_window("ts", "1998-01-01", 12) & F.col("rel_week").between(-12, 12)).select(
        "o_orderkey", "rel_week")


@register("filt_having_count", """
SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL
GROUP BY source, lang HAVING count(*) >= 3""")
def filt_having_count(spark, d):
    docs = ag.drop_null_keys(table(spark, d, "documents"), ["source", "lang"])
    return docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 3)


@register("filt_notnull", """
SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL""")
def filt_notnull(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    lab = table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(lab, "doc_id", "left").where(F.col("quality").isNotNull())


@register("filt_ieq", """
SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000042')""")
def filt_ieq(spark, d):
    return table(spark, d, "customer").where(fx.ci_equal("c_name", F.lit("CUSTOMER#000000042"))).select(
        "c_custkey", "c_name")

# ---------------------------------------------------------------- follow graph (events-derived)


def follow_lists(spark, d):
    """following = users with a purchase before 2024-01-04; followers = users with a signup
    between 2024-01-15 and 2024-01-17 (inclusive days)."""
    ev = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    following = (ev.where((F.col("event_type") == "purchase") & (F.col("ts") < F.to_timestamp(F.lit("2024-01-04"))))
                 .select(F.col("user_id").alias("account_id")).distinct())
    followers = (ev.where((F.col("event_type") == "signup") & (F.col("ts") >= F.to_timestamp(F.lit("2024-01-15")))
                          & (F.col("ts") < F.to_timestamp(F.lit("2024-01-18"))))
                 .select(F.col("user_id").alias("account_id")).distinct())
    return following, followers


SQL_FOLLOW = """
following AS (SELECT DISTINCT user_id AS account_id FROM events
              WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-04' AND user_id IS NOT NULL),
followers AS (SELECT DISTINCT user_id AS account_id FROM events
              WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-18'
                AND user_id IS NOT NULL)"""

SQL_SUMMARY = "WITH " + SQL_FOLLOW + """,
s AS (SELECT (SELECT count(*) FROM following) AS f, (SELECT count(*) FROM followers) AS r,
             (SELECT count(*) FROM (SELECT account_id FROM following INTERSECT SELECT account_id FROM followers)) AS m),
summary AS (SELECT f AS total_following, r AS total_followers, m AS total_mutual,
  CASE WHEN f > 0 THEN m / f * 100.0 ELSE 0.0 END AS pct_following_back,
  CASE WHEN r > 0 THEN m / r * 100.0 ELSE 0.0 END AS pct_followed_back,
  CASE WHEN f > 0 THEN r / f ELSE 0.0 END AS follow_ratio,
  f - m AS following_only, r - m AS followers_only FROM s)"""


@register("join_mutuals", "WITH " + SQL_FOLLOW + """
SELECT account_id FROM following WHERE account_id IN (SELECT account_id FROM followers)""")
def join_mutuals(spark, d):
    a, b = follow_lists(spark, d)
    return nw.mutuals(a, b)


@register("set_intersect", "WITH " + SQL_FOLLOW + """
SELECT account_id FROM following INTERSECT SELECT account_id FROM followers""")
def set_intersect(spark, d):
    a, b = follow_lists(spark, d)
    return a.intersect(b)


@register("set_except", "WITH " + SQL_FOLLOW + """
SELECT (SELECT count(*) FROM (SELECT account_id FROM following EXCEPT SELECT account_id FROM followers)) AS following_only,
       (SELECT count(*) FROM (SELECT account_id FROM followers EXCEPT SELECT account_id FROM following)) AS followers_only""")
def set_except(spark, d):
    a, b = follow_lists(spark, d)
    fo = a.subtract(b).agg(F.count(F.lit(1)).alias("following_only"))
    return fo.select("following_only", b.subtract(a).agg(F.count(F.lit(1))).scalar().alias("followers_only"))


@register("set_union_all", "WITH " + SQL_FOLLOW + """
SELECT 'following' AS list, account_id FROM following UNION ALL SELECT 'follower' AS list, account_id FROM followers""")
def set_union_all(spark, d):
    a, b = follow_lists(spark, d)
    return (a.select(F.lit("following").alias("list"), "account_id")
            .unionByName(b.select(F.lit("follower").alias("list"), "account_id")))


@register("agg_network_summary", SQL_SUMMARY + """
SELECT total_following, total_followers, total_mutual, round_even(pct_following_back, 6) AS pct_following_back,
  round_even(pct_followed_back, 6) AS pct_followed_back, round_even(follow_ratio, 6) AS follow_ratio,
  following_only, followers_only FROM summary""")
def agg_network_summary(spark, d):
    a, b = follow_lists(spark, d)
    s = nw.network_summary(a, b)
    return s.select("total_following", "total_followers", "total_mutual", r6("pct_following_back").alias("pct_following_back"),
                    r6("pct_followed_back").alias("pct_followed_back"), r6("follow_ratio").alias("follow_ratio"),
                    "following_only", "followers_only")


@register("rule_insights", SQL_SUMMARY + """
SELECT * FROM (
  SELECT 'reciprocity' AS rule,
    CASE WHEN pct_following_back < 30 THEN 'low' WHEN pct_following_back > 70 THEN 'high' ELSE 'moderate' END AS level,
    printf('%.1f', pct_following_back) AS value FROM summary
  UNION ALL
  SELECT 'followed_back', CASE WHEN pct_followed_back < 20 THEN 'selective' WHEN pct_followed_back > 50 THEN 'high' END,
    printf('%.1f', pct_followed_back) FROM summary
  UNION ALL
  SELECT 'follow_ratio', CASE WHEN follow_ratio > 2 THEN 'influencer' WHEN follow_ratio < 0.5 THEN 'consumer' END,
    printf('%.2f', follow_ratio) FROM summary
  UNION ALL
  SELECT 'direction', CASE WHEN follow_ratio > 1 THEN 'more_followers' WHEN follow_ratio < 1 THEN 'more_following' ELSE 'equal' END,
    CASE WHEN follow_ratio < 1 THEN printf('%.2f', CASE WHEN follow_ratio > 0 THEN 1.0 / follow_ratio END) ELSE printf('%.2f', follow_ratio) END
  FROM summary) WHERE level IS NOT NULL""")
def rule_insights(spark, d):
    a, b = follow_lists(spark, d)
    return nw.rule_insights(nw.network_summary(a, b))

# ---------------------------------------------------------------- joins


@register("join_lookup_left", """
WITH last AS (
  SELECT o_custkey, o_orderkey, o_orderdate,
         ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT c.c_custkey, l.o_orderkey AS most_recent_order, strftime(l.o_orderdate, '%Y-%m-%d') AS most_recent_order_date
FROM customer c LEFT JOIN last l ON c.c_custkey = l.o_custkey AND l.rn = 1""")
def join_lookup_left(spark, d):
    from postmetrics.operators.joins import latest_per_key, lookup_left
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    last = latest_per_key(o, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate"])
    c = table(spark, d, "customer").select("c_custkey")
    j = lookup_left(c, last, c["c_custkey"] == last["o_custkey"])
    return j.select("c_custkey", F.col("o_orderkey").alias("most_recent_order"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("most_recent_order_date"))


@register("join_scalar_threshold", "WITH " + SQL_CAPPED + """
SELECT post_id, round_even(engagement, 6) AS engagement, round_even((SELECT quantile_cont(engagement, 0.95) FROM posts), 6) AS cap,
  engagement > (SELECT quantile_cont(engagement, 0.95) FROM posts) AS above_cap FROM capped""")
def join_scalar_threshold(spark, d):
    p = posts(spark, d)
    cap = F.lit(ag.cap_value(p, "engagement", 0.95)).cast("double")
    return p.select("post_id", r6("engagement").alias("engagement"), r6(cap).alias("cap"),
                    (F.col("engagement") > cap).alias("above_cap"))


@register("join_owner_lookup", """
WITH a AS (SELECT user_id, 'user' || CAST(user_id AS VARCHAR) AS screen_name FROM events),
hint AS (SELECT CAST(user_id AS VARCHAR) AS o FROM a WHERE lower(screen_name) = lower('USER42')
         GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1),
modal AS (SELECT CAST(user_id AS VARCHAR) AS o FROM a WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)
SELECT COALESCE((SELECT o FROM hint), (SELECT o FROM modal)) AS owner_id""")
def join_owner_lookup(spark, d):
    from postmetrics.operators.joins import infer_owner
    ev = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("author_id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("screen_name"),
        F.lit(None).cast("string").alias("reply_to"))
    return infer_owner(ev, "author_id", "screen_name", "reply_to", hint="USER42")

# ---------------------------------------------------------------- windows, strata, samples

SQL_RANKED_ORDERS = """
WITH r AS (SELECT o_orderkey, o_totalprice,
  ROW_NUMBER() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) - 1 AS rn,
  count(*) OVER () AS n FROM orders)"""
SQL_QUARTILE = SQL_RANKED_ORDERS + """,
q AS (SELECT o_orderkey, CAST(1 + (rn >= n // 4)::INT + (rn >= n // 2)::INT + (rn >= (3 * n) // 4)::INT AS INTEGER) AS stratum FROM r)"""
SQL_THREE = SQL_RANKED_ORDERS + """,
q3 AS (SELECT o_orderkey, CASE WHEN rn < n // 4 THEN 'high' WHEN rn < (3 * n) // 4 THEN 'mid' ELSE 'low' END AS stratum FROM r)"""
SQL_SEEDED = "md5(CAST(o_orderkey AS VARCHAR) || ':42')"


@register("win_quartile_strata", SQL_QUARTILE + " SELECT o_orderkey, stratum FROM q")
def win_quartile_strata(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return st.quartile_strata(o, "o_totalprice", "o_orderkey").select("o_orderkey", "stratum")


@register("win_three_strata", SQL_THREE + " SELECT o_orderkey, stratum FROM q3")
def win_three_strata(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return st.three_strata(o, "o_totalprice", "o_orderkey").select("o_orderkey", "stratum")


@register("win_stratified_sample", SQL_QUARTILE + f"""
SELECT o_orderkey, stratum FROM (
  SELECT o_orderkey, stratum, ROW_NUMBER() OVER (PARTITION BY stratum ORDER BY {SQL_SEEDED}, o_orderkey) AS rn FROM q)
WHERE rn <= 125""")
def win_stratified_sample(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    s = st.quartile_strata(o, "o_totalprice", "o_orderkey")
    smp = st.stratified_sample(s, "stratum", "o_orderkey", 500 // 4).select("o_orderkey", "stratum")
    # concatenation of the strata, then keep-first on id (first = earliest stratum)
    return st.dedupe_keep_first(smp, ["o_orderkey"], ["stratum"])


@register("win_quota_sample", SQL_THREE + f"""
SELECT o_orderkey, stratum FROM (
  SELECT o_orderkey, stratum, ROW_NUMBER() OVER (PARTITION BY stratum ORDER BY {SQL_SEEDED}, o_orderkey) AS rn FROM q3)
WHERE rn <= CASE stratum WHEN 'high' THEN 8 WHEN 'mid' THEN 8 ELSE 4 END
ORDER BY CASE stratum WHEN 'high' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END, rn LIMIT 15""")
def win_quota_sample(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    s = st.three_strata(o, "o_totalprice", "o_orderkey")
    smp = st.stratified_sample(s, "stratum", "o_orderkey", {"high": 8, "mid": 8, "low": 4}, name="_pos")
    rank = F.when(F.col("stratum") == "high", 0).when(F.col("stratum") == "mid", 1).otherwise(2)
    # the first N of the concatenation: a bounded top-k is the feature here
    return smp.orderBy(rank, "_pos").limit(15).select("o_orderkey", "stratum")


@register("win_batches", """
SELECT c_custkey, CAST((ROW_NUMBER() OVER (ORDER BY c_custkey) - 1) // 100 AS BIGINT) AS batch FROM customer""")
def win_batches(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    idx = with_global_index(c, [F.col("c_custkey")], "_i")
    return idx.select("c_custkey", F.floor(F.col("_i") / 100).cast("bigint").alias("batch"))


@register("win_entity_demean", """
WITH g AS (SELECT avg(l_extendedprice) AS gp, avg(l_quantity) AS gq FROM lineitem),
e AS (SELECT l_suppkey, avg(l_extendedprice) AS ep, avg(l_quantity) AS eq FROM lineitem GROUP BY l_suppkey)
SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey,
  round_even(l.l_extendedprice - e.ep + (SELECT gp FROM g), 6) AS price_dm,
  round_even(l.l_quantity - e.eq + (SELECT gq FROM g), 6) AS qty_dm
FROM lineitem l JOIN e ON l.l_suppkey = e.l_suppkey""")
def win_entity_demean(spark, d):
    from postmetrics.operators.joins import entity_demean
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
    dm = entity_demean(li, "l_suppkey", ["l_extendedprice", "l_quantity"])
    return dm.select("l_orderkey", "l_linenumber", "l_suppkey", r6("l_extendedprice").alias("price_dm"),
                     r6("l_quantity").alias("qty_dm"))


@register("win_second_best", SQL_CATEGORY_STATS + """
SELECT category, round_even(mean, 6) AS mean FROM stats ORDER BY mean DESC, category LIMIT 1 OFFSET 1""")
def win_second_best(spark, d):
    s = ag.group_stats(capped_events(spark, d), ["category"], "winsorized", ("mean",))
    top2 = s.orderBy(F.desc("mean"), "category").limit(2)  # bounded top-k over the group table
    return top2.orderBy(F.asc("mean"), F.desc("category")).limit(1).select("category", r6("mean").alias("mean"))

# ---------------------------------------------------------------- sorts and limits


@register("sort_time", """
SELECT event_id AS post_id, ROW_NUMBER() OVER (ORDER BY ts ASC NULLS LAST, event_id) - 1 AS position FROM events""")
def sort_time(spark, d):
    p = posts(spark, d).select("post_id", "post_datetime")
    idx = with_global_index(p, [F.col("post_datetime").asc_nulls_last(), F.col("post_id")], "position")
    return idx.select("post_id", "position")


@register("sort_value_desc", """
SELECT event_id AS post_id, ROW_NUMBER() OVER (ORDER BY value DESC NULLS LAST, event_id) - 1 AS position FROM events""")
def sort_value_desc(spark, d):
    p = posts(spark, d).select("post_id", "engagement")
    idx = with_global_index(p, [F.col("engagement").desc_nulls_last(), F.col("post_id")], "position")
    return idx.select("post_id", "position")


@register("limit_head", SQL_ORDERS_REL + " SELECT * FROM es ORDER BY rel_week LIMIT 10")
def limit_head(spark, d):
    return event_study(spark, d).orderBy("rel_week").limit(10)


@register("limit_tail", """
WITH c AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus,
  CASE WHEN o_totalprice > (SELECT quantile_cont(o_totalprice, 0.95) FROM orders) THEN (SELECT quantile_cont(o_totalprice, 0.95) FROM orders) ELSE o_totalprice END AS w, o_totalprice FROM orders),
m AS (SELECT month, o_orderstatus, round_even(avg(w), 6) AS mean_capped, count(o_totalprice) AS count
      FROM c WHERE month IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY month, o_orderstatus)
SELECT * FROM m ORDER BY month DESC, o_orderstatus DESC LIMIT 12""")
def limit_tail(spark, d):
    return monthly(spark, d).orderBy(F.desc("month"), F.desc("o_orderstatus")).limit(12)


@register("limit_top1", SQL_CATEGORY_STATS + """
SELECT category, round_even(mean, 6) AS mean FROM stats ORDER BY mean DESC, category LIMIT 1""")
def limit_top1(spark, d):
    s = ag.group_stats(capped_events(spark, d), ["category"], "winsorized", ("mean",))
    return s.orderBy(F.desc("mean"), "category").limit(1).select("category", r6("mean").alias("mean"))

# ---------------------------------------------------------------- distinct


@register("set_distinct", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST) AS rn FROM lineitem) WHERE rn = 1""")
def set_distinct(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return st.dedupe_keep_first(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])

