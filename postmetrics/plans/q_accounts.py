"""Queries over many accounts in one frame: owners, caps, tiers and follow lists by account.

An account's posts are the events of one type.  Its author is the event's user (unknown for
purchases, whose owner then comes from the reply targets); two accounts have a screen-name hint that
some post bears, one a hint that none does; two have period boundaries of their own.  Follow edges:
an account is user_id % 40, but every third user belongs to account 0, which so holds most edges.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postmetrics.operators import accounts as ac
from postmetrics.operators import network as nw
from postmetrics.plans.derived import EVENT_TIER_A, EVENT_TIER_B
from postmetrics.plans.registry import r6, register
from postmetrics.sources.tables import posts, table

HINTS = [("view", "USER42"), ("click", "user7"), ("signup", "nobody")]
BOUNDARIES = [("view", "2024-01-05", "2024-01-09"), ("purchase", "2024-01-15", "2024-01-25")]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)


SQL_ACCOUNTS = f"""
WITH p AS (
  SELECT event_id AS post_id, event_type AS account, ts, value, CASE WHEN event_type <> 'purchase' THEN CAST(user_id AS VARCHAR) END AS author,
         'user' || CAST(user_id AS VARCHAR) AS screen,
         CAST(user_id - TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS target FROM events),
h(account, screen_name) AS (VALUES {_values(HINTS)}),
b(account, s, e) AS (VALUES {_values(BOUNDARIES)}),
votes AS (
  SELECT p.account, 0 AS rank, author AS id FROM p JOIN h ON p.account = h.account AND lower(screen) = lower(screen_name)
  UNION ALL SELECT account, 1, author FROM p UNION ALL SELECT account, 2, target FROM p),
ranked AS (
  SELECT account, id, row_number() OVER (PARTITION BY account ORDER BY rank, n DESC, id) AS place
  FROM (SELECT account, rank, id, count(*) AS n FROM votes WHERE id IS NOT NULL GROUP BY account, rank, id)),
dim AS (
  SELECT q.account, o.id AS owner_id, q.cap, coalesce(CAST(b.s AS TIMESTAMP), TIMESTAMP '{EVENT_TIER_A}') AS tier_start,
         coalesce(CAST(b.e AS TIMESTAMP), TIMESTAMP '{EVENT_TIER_B}') AS tier_end
  FROM (SELECT account, quantile_cont(value, 0.95) AS cap FROM p GROUP BY account) q
  LEFT JOIN ranked o ON q.account IS NOT DISTINCT FROM o.account AND o.place = 1
  LEFT JOIN b ON q.account = b.account)"""


def _account_posts(spark, d):
    p = posts(spark, d)
    user = F.col("author_id").cast("string")
    return p.select("post_id", F.col("category").alias("account"), "post_datetime", "engagement",
                    F.when(F.col("category") != "purchase", user).alias("author"), F.concat(F.lit("user"), user).alias("screen"),
                    (F.col("author_id") - F.col("k") % 5).cast("string").alias("target"))


def _dimension(spark, p):
    hints = spark.createDataFrame(HINTS, "account string, screen_name string")
    own = spark.createDataFrame(BOUNDARIES, "account string, s string, e string").select(
        "account", F.to_timestamp("s").alias("tier_start"), F.to_timestamp("e").alias("tier_end"))
    owner = ac.owners(p, "account", "author", "screen", "target", hints)
    return ac.account_dimension(p, "account", "engagement", owner, own, tier_start=EVENT_TIER_A, tier_end=EVENT_TIER_B)


@register("join_account_dimension", SQL_ACCOUNTS + """
SELECT account, owner_id, round_even(cap, 6) AS cap, strftime(tier_start, '%Y-%m-%d') AS tier_start, strftime(tier_end, '%Y-%m-%d') AS tier_end
FROM dim""")
def join_account_dimension(spark, d):
    """Owner, cap and boundaries of every account."""
    dim = _dimension(spark, _account_posts(spark, d))
    return dim.select("account", "owner_id", r6("cap").alias("cap"), F.date_format("tier_start", "yyyy-MM-dd").alias("tier_start"),
                      F.date_format("tier_end", "yyyy-MM-dd").alias("tier_end"))


@register("agg_account_features", SQL_ACCOUNTS + """
SELECT p.account, CASE WHEN target IS NULL THEN 'none' WHEN target = owner_id AND owner_id <> '' THEN 'reply_own' ELSE 'reply_other' END AS reply_type,
  CASE WHEN ts < tier_start THEN 'tier_pre_upgrade' WHEN ts >= tier_start AND ts <= tier_end THEN 'tier_upgraded' ELSE 'tier_post_upgrade' END AS account_tier,
  count(*) AS n, round_even(avg(CASE WHEN value > cap THEN cap ELSE value END), 6) AS mean_capped
FROM p LEFT JOIN dim ON p.account IS NOT DISTINCT FROM dim.account GROUP BY ALL""")
def agg_account_features(spark, d):
    """Posts of all accounts by reply type and tier, each judged by its own account's owner, dates and cap."""
    p = _account_posts(spark, d)
    f = ac.with_account_features(p, _dimension(spark, p), "account", "target", "post_datetime", "engagement")
    g = f.groupBy("account", "reply_type", "account_tier").agg(F.count("*").alias("n"), F.avg("winsorized").alias("m"))
    return g.select("account", "reply_type", "account_tier", "n", r6("m").alias("mean_capped"))


SQL_EDGES = """
WITH ev AS (SELECT CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 40 END AS account_id, user_id AS other_id, event_type
            FROM events WHERE user_id IS NOT NULL),
following AS (SELECT DISTINCT account_id, other_id FROM ev WHERE event_type IN ('purchase', 'click')),
followers AS (SELECT DISTINCT account_id, other_id FROM ev WHERE event_type = 'signup')"""


def _edges(spark, d):
    ev = table(spark, d, "events").select(
        F.when(F.col("user_id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("user_id") % 40).alias("account_id"),
        F.col("user_id").alias("other_id"), "event_type")
    return ev.where(F.col("event_type").isin("purchase", "click")), ev.where(F.col("event_type") == "signup")


@register("join_mutuals_by_account", SQL_EDGES + """
SELECT account_id, other_id FROM following INTERSECT SELECT account_id, other_id FROM followers""")
def join_mutuals_by_account(spark, d):
    """Mutual pairs of every account; account 0 has most edges."""
    return nw.mutuals_by_account(*_edges(spark, d))


@register("agg_network_by_account", SQL_EDGES + """,
j AS (SELECT coalesce(a.account_id, b.account_id) AS account_id, a.other_id IS NOT NULL AS f, b.other_id IS NOT NULL AS r
      FROM following a FULL OUTER JOIN followers b ON a.account_id = b.account_id AND a.other_id = b.other_id),
s AS (SELECT account_id, count(*) FILTER (f) AS f, count(*) FILTER (r) AS r, count(*) FILTER (f AND r) AS m FROM j GROUP BY account_id)
SELECT account_id, f AS total_following, r AS total_followers, m AS total_mutual,
  round_even(CASE WHEN f > 0 THEN m / f * 100.0 ELSE 0.0 END, 6) AS pct_following_back,
  round_even(CASE WHEN r > 0 THEN m / r * 100.0 ELSE 0.0 END, 6) AS pct_followed_back,
  round_even(CASE WHEN f > 0 THEN r / f ELSE 0.0 END, 6) AS follow_ratio, f - m AS following_only, r - m AS followers_only FROM s""")
def agg_network_by_account(spark, d):
    s = nw.network_summary_by_account(*_edges(spark, d))
    shares = ("pct_following_back", "pct_followed_back", "follow_ratio")
    return s.select(*[r6(c).alias(c) if c in shares else F.col(c) for c in s.columns])
