"""Aggregation queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmetrics.functions import features as fx
from postmetrics.functions.numeric import round_half_even
from postmetrics.operators import aggregates as ag
from postmetrics.operators.quantiles import quantiles
from postmetrics.plans.derived import SQL_CORE, SQL_ENGINEERED, core_sample, engineered
from postmetrics.plans.registry import SQL_POSTS, r6, register
from postmetrics.sources.tables import posts, table


def capped_events(spark, d):
    """Events with the 95%-capped value."""
    return ag.cap_column(posts(spark, d), "engagement", fx.WINSORIZE_THRESHOLD, "winsorized")


def category_stats(spark, d):
    """Flagship: which category performs best once outliers are capped?"""
    s = ag.group_stats(capped_events(spark, d), ["category"], "winsorized", ("count", "mean", "median", "std"))
    return s.select("category", "count", r6("mean").alias("mean"), r6("median").alias("median"),
                    r6("std").alias("std")).orderBy(F.desc("mean"), "category")


SQL_CAPPED = SQL_POSTS + """,
capped AS (SELECT *, CASE WHEN engagement > (SELECT quantile_cont(engagement, 0.95) FROM posts) THEN (SELECT quantile_cont(engagement, 0.95) FROM posts) ELSE engagement END AS winsorized FROM posts)"""

SQL_CATEGORY_STATS = "WITH " + SQL_CAPPED + """,
stats AS (
  SELECT category, count(winsorized) AS count, avg(winsorized) AS mean,
         median(winsorized) AS median, stddev_samp(winsorized) AS std
  FROM capped WHERE category IS NOT NULL GROUP BY category)"""


@register("agg_group_stats", SQL_CATEGORY_STATS + """
SELECT category, count, round_even(mean, 6) AS mean, round_even(median, 6) AS median, round_even(std, 6) AS std
FROM stats""")
def agg_group_stats(spark, d):
    return category_stats(spark, d)


@register("agg_mean_median", "WITH " + SQL_POSTS + """
SELECT category, round_even(avg(engagement), 6) AS mean, round_even(median(engagement), 6) AS median
FROM posts WHERE category IS NOT NULL GROUP BY category""")
def agg_mean_median(spark, d):
    s = ag.group_stats(posts(spark, d), ["category"], "engagement", ("mean", "median"))
    return s.select("category", r6("mean").alias("mean"), r6("median").alias("median")).orderBy(F.desc("mean"))


@register("agg_topic_having", """
WITH c AS (SELECT o_custkey, CASE WHEN o_totalprice > (SELECT quantile_cont(o_totalprice, 0.95) FROM orders) THEN (SELECT quantile_cont(o_totalprice, 0.95) FROM orders) ELSE o_totalprice END AS w FROM orders)
SELECT o_custkey, count(w) AS count, round_even(avg(w), 6) AS mean, round_even(median(w), 6) AS median
FROM c WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING count(w) >= 3""")
def agg_topic_having(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    c = ag.cap_column(o, "o_totalprice", fx.WINSORIZE_THRESHOLD, "w")
    s = ag.group_stats(c, ["o_custkey"], "w", ("count", "mean", "median"))
    return (s.where(F.col("count") >= 3)
            .select("o_custkey", "count", r6("mean").alias("mean"), r6("median").alias("median"))
            .orderBy(F.desc("mean"), "o_custkey"))


@register("agg_advantage_top2", SQL_CATEGORY_STATS + """,
r AS (SELECT category, mean, ROW_NUMBER() OVER (ORDER BY mean DESC, category) AS rn FROM stats)
SELECT max(CASE WHEN rn = 1 THEN category END) AS best,
       max(CASE WHEN rn = 2 THEN category END) AS second,
       round_even(max(CASE WHEN rn = 1 THEN round_even(mean, 1) END) / max(CASE WHEN rn = 2 THEN round_even(mean, 1) END), 6) AS advantage
FROM r WHERE rn <= 2""")
def agg_advantage_top2(spark, d):
    s = ag.group_stats(capped_events(spark, d), ["category"], "winsorized", ("mean",))
    # best and second-best group (mean desc, then name): min_by keeps O(1) state, no sort
    # of the group table and no join - the runner-up excludes the best by a scalar subquery
    pick = F.min_by(F.struct("category", "mean"), F.struct(-F.col("mean"), F.col("category")))
    best = s.agg(pick.alias("b"))
    second = s.where(F.col("category") != best.select("b.category").scalar()).agg(pick.alias("r"))
    r = second.select("r").scalar()
    return best.select(F.col("b.category").alias("best"), r["category"].alias("second"),
                       r6(ag.ratio_of_rounded(F.col("b.mean"), r["mean"], 1)).alias("advantage"))


BOOL_FEATURES_SQL = """
f AS (
  SELECT 'is_reply' AS feature, category IN ('view', 'click') AS flag, winsorized FROM capped
  UNION ALL
  SELECT 'high_k' AS feature, k >= 50 AS flag, winsorized FROM capped)"""


@register("agg_advantage_bool", "WITH " + SQL_CAPPED + "," + BOOL_FEATURES_SQL + """,
g AS (SELECT feature, flag, count(winsorized) AS n, avg(winsorized) AS mean FROM f WHERE flag IS NOT NULL GROUP BY feature, flag)
SELECT feature,
  max(CASE WHEN flag THEN n END) AS n_true, round_even(max(CASE WHEN flag THEN mean END), 6) AS mean_true,
  max(CASE WHEN NOT flag THEN n END) AS n_false, round_even(max(CASE WHEN NOT flag THEN mean END), 6) AS mean_false,
  round_even(round_even(max(CASE WHEN flag THEN mean END), 1) / round_even(max(CASE WHEN NOT flag THEN mean END), 1), 6) AS advantage
FROM g GROUP BY feature""")
def agg_advantage_bool(spark, d):
    c = capped_events(spark, d)
    long = c.select(F.explode(F.array(
        F.struct(F.lit("is_reply").alias("feature"), F.col("category").isin("view", "click").alias("flag"),
                 F.col("winsorized").alias("winsorized")),
        F.struct(F.lit("high_k").alias("feature"), (F.col("k") >= 50).alias("flag"),
                 F.col("winsorized").alias("winsorized")))).alias("s")).select("s.*")
    g = ag.drop_null_keys(long, ["feature", "flag"]).groupBy("feature").agg(
        F.count(F.when(F.col("flag"), F.col("winsorized"))).alias("n_true"),
        F.avg(F.when(F.col("flag"), F.col("winsorized"))).alias("mt"),
        F.count(F.when(~F.col("flag"), F.col("winsorized"))).alias("n_false"),
        F.avg(F.when(~F.col("flag"), F.col("winsorized"))).alias("mf"))
    return g.select("feature", "n_true", r6("mt").alias("mean_true"), "n_false", r6("mf").alias("mean_false"),
                    r6(ag.ratio_of_rounded(F.col("mt"), F.col("mf"), 1)).alias("advantage"))


WEEKDAYS = ["Friday", "Monday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday"]


@register("agg_pivot_mean", "WITH " + SQL_CAPPED + """
SELECT category, """ + ", ".join(
    f"round_even(avg(winsorized) FILTER (WHERE dayname(post_datetime) = '{w}'), 6) AS \"{w}\"" for w in WEEKDAYS) + """
FROM capped WHERE category IS NOT NULL GROUP BY category""")
def agg_pivot_mean(spark, d):
    c = capped_events(spark, d).withColumn("weekday", fx.weekday_name("post_datetime"))
    pv = ag.pivot_mean(c, "category", "weekday", "winsorized", WEEKDAYS)
    return pv.select("category", *[r6(F.col(w)).alias(w) for w in WEEKDAYS])


@register("agg_global_median", "WITH " + SQL_CAPPED + """
SELECT round_even(median(winsorized), 6) AS median FROM capped""")
def agg_global_median(spark, d):
    q = quantiles(capped_events(spark, d), "winsorized", [0.5], names=["median"])
    return q.select(r6("median").alias("median"))


@register("agg_quantile", """
SELECT round_even(quantile_cont(value, 0.90), 6) AS q90, round_even(quantile_cont(value, 0.95), 6) AS q95,
       round_even(quantile_cont(value, 0.99), 6) AS q99 FROM events""")
def agg_quantile(spark, d):
    q = quantiles(table(spark, d, "events"), "value", [0.90, 0.95, 0.99], names=["q90", "q95", "q99"])
    return q.select(*[r6(c).alias(c) for c in ("q90", "q95", "q99")])


@register("agg_value_counts", "WITH " + SQL_ENGINEERED + ", " + SQL_CORE + """
SELECT reply_type, count(*) AS count FROM core WHERE reply_type IS NOT NULL GROUP BY reply_type""")
def agg_value_counts(spark, d):
    return ag.value_counts(core_sample(engineered(spark, d)), "reply_type").orderBy(F.desc("count"), "reply_type")


@register("agg_bool_share", """
SELECT 'url_has_query' AS feature, round_even(avg(CAST(contains(url, '?') AS DOUBLE)), 6) AS share FROM pages
UNION ALL SELECT 'url_has_fragment', round_even(avg(CAST(contains(url, '#') AS DOUBLE)), 6) FROM pages
UNION ALL SELECT 'html_has_question_mark', round_even(avg(CAST(contains(html, '?') AS DOUBLE)), 6) FROM pages""")
def agg_bool_share(spark, d):
    pg = table(spark, d, "pages").select(
        fx.has_question_mark("url").alias("url_has_query"),
        F.col("url").contains("#").alias("url_has_fragment"),
        fx.has_question_mark("html").alias("html_has_question_mark"))
    s = ag.bool_share(pg, ["url_has_query", "url_has_fragment", "html_has_question_mark"])
    return s.select("feature", r6("share").alias("share"))


@register("agg_bool_sum", "WITH " + SQL_ENGINEERED + """
SELECT count(*) FILTER (WHERE is_quote_tweet) AS n_quotes, count(*) AS n_rows
FROM eng WHERE NOT is_retweet AND reply_type IN ('none', 'reply_other')""")
def agg_bool_sum(spark, d):
    e = engineered(spark, d)
    s = e.where(~F.col("is_retweet") & F.col("reply_type").isin(fx.REPLY_NONE, fx.REPLY_OTHER))
    return s.agg(F.count_if(F.col("is_quote_tweet")).alias("n_quotes"), F.count(F.lit(1)).alias("n_rows"))


SQL_TWO_KEY = "WITH " + SQL_ENGINEERED + ", " + SQL_CORE


@register("agg_two_key_stats", SQL_TWO_KEY + """
SELECT account_tier, reply_type, round_even(avg(winsorized_engagement), 6) AS mean,
       round_even(median(winsorized_engagement), 6) AS median, count(winsorized_engagement) AS count
FROM core WHERE account_tier IS NOT NULL AND reply_type IS NOT NULL GROUP BY account_tier, reply_type""")
def agg_two_key_stats(spark, d):
    s = ag.group_stats(core_sample(engineered(spark, d, cap=True)), ["account_tier", "reply_type"],
                       "winsorized_engagement", ("mean", "median", "count"))
    return s.select("account_tier", "reply_type", r6("mean").alias("mean"), r6("median").alias("median"), "count")


@register("agg_mean_sd_cells", SQL_TWO_KEY + """
SELECT account_tier, reply_type, round_even(avg(winsorized_engagement), 6) AS mean,
       round_even(stddev_samp(winsorized_engagement), 6) AS sd
FROM core WHERE account_tier IS NOT NULL AND reply_type IS NOT NULL GROUP BY account_tier, reply_type""")
def agg_mean_sd_cells(spark, d):
    s = ag.group_stats(core_sample(engineered(spark, d, cap=True)), ["account_tier", "reply_type"],
                       "winsorized_engagement", ("mean", "std"))
    return s.select("account_tier", "reply_type", r6("mean").alias("mean"), r6("std").alias("sd"))


@register("agg_two_key_pivot", SQL_TWO_KEY + """
SELECT account_tier,
  round_even(avg(winsorized_engagement) FILTER (WHERE reply_type = 'none'), 6) AS "none",
  round_even(avg(winsorized_engagement) FILTER (WHERE reply_type = 'reply_other'), 6) AS "reply_other"
FROM core WHERE account_tier IS NOT NULL AND reply_type IS NOT NULL GROUP BY account_tier""")
def agg_two_key_pivot(spark, d):
    pv = ag.pivot_mean(core_sample(engineered(spark, d, cap=True)), "account_tier", "reply_type",
                       "winsorized_engagement", [fx.REPLY_NONE, fx.REPLY_OTHER])
    return pv.select("account_tier", r6("none").alias("none"), r6("reply_other").alias("reply_other"))


STATUSES = ["F", "O", "P"]


@register("agg_month_pivot", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, """ + ", ".join(
    f"round_even(avg(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 6) AS \"{s}\"" for s in STATUSES) + """
FROM orders WHERE o_orderdate IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1""")
def agg_month_pivot(spark, d):
    o = table(spark, d, "orders").select(fx.month_label(F.col("o_orderdate").cast("timestamp")).alias("month"),
                                         "o_orderstatus", "o_totalprice")
    pv = ag.pivot_mean(o, "month", "o_orderstatus", "o_totalprice", STATUSES)
    return pv.select("month", *[r6(s).alias(s) for s in STATUSES]).orderBy("month")


@register("agg_box_stats", """
WITH q AS (
  SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.75) AS q3
  FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY event_type),
j AS (SELECT e.event_type, e.value, q.q1, q.median, q.q3, q.q3 - q.q1 AS iqr
      FROM events e JOIN q ON e.event_type = q.event_type WHERE e.value IS NOT NULL)
SELECT event_type, count(value) AS n, round_even(any_value(q1), 6) AS q1, round_even(any_value(median), 6) AS median,
  round_even(any_value(q3), 6) AS q3,
  round_even(min(CASE WHEN value >= q1 - 1.5 * iqr THEN value END), 6) AS whisker_low,
  round_even(max(CASE WHEN value <= q3 + 1.5 * iqr THEN value END), 6) AS whisker_high,
  count(CASE WHEN value < q1 - 1.5 * iqr OR value > q3 + 1.5 * iqr THEN 1 END) AS n_outliers
FROM j GROUP BY event_type""")
def agg_box_stats(spark, d):
    b = ag.box_stats(table(spark, d, "events"), "event_type", "value")
    return b.select("event_type", "n", *[r6(c).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")],
                    "n_outliers")


def orders_relative(spark, d, event="1998-01-01"):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"),
                                         "o_totalprice")
    o = ag.cap_column(o, "o_totalprice", fx.WINSORIZE_THRESHOLD, "w")
    return o.withColumn("rel_week", fx.relative_week("ts", F.to_timestamp(F.lit(event))))


SQL_ORDERS_REL = """
WITH c AS (
  SELECT o_orderkey, o_orderdate AS ts, o_totalprice,
    CASE WHEN o_totalprice > (SELECT quantile_cont(o_totalprice, 0.95) FROM orders) THEN (SELECT quantile_cont(o_totalprice, 0.95) FROM orders) ELSE o_totalprice END AS w,
    CAST(floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-01-01')) / 604800000000.0) AS INTEGER) AS rel_week
  FROM orders),
es AS (
  SELECT rel_week, round_even(avg(o_totalprice), 6) AS mean, round_even(median(o_totalprice), 6) AS median,
         count(o_totalprice) AS count, round_even(avg(w), 6) AS mean_capped
  FROM c WHERE rel_week BETWEEN -12 AND 12 GROUP BY rel_week)"""


def event_study(spark, d):
    o = orders_relative(spark, d).where(fx.relative_week_window("ts", "1998-01-01", 12)
                                        & F.col("rel_week").between(-12, 12))
    s = ag.group_stats(o, ["rel_week"], "o_totalprice", ("mean", "median", "count"))
    capped_mean = o.groupBy("rel_week").agg(F.avg("w").alias("mean_capped"))
    return s.join(capped_mean, "rel_week").select(
        "rel_week", r6("mean").alias("mean"), r6("median").alias("median"), "count",
        r6("mean_capped").alias("mean_capped"))


@register("agg_event_study", SQL_ORDERS_REL + " SELECT * FROM es")
def agg_event_study(spark, d):
    return event_study(spark, d).orderBy("rel_week")


@register("agg_monthly", """
WITH c AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus,
  CASE WHEN o_totalprice > (SELECT quantile_cont(o_totalprice, 0.95) FROM orders) THEN (SELECT quantile_cont(o_totalprice, 0.95) FROM orders) ELSE o_totalprice END AS w, o_totalprice FROM orders)
SELECT month, o_orderstatus, round_even(avg(w), 6) AS mean_capped, count(o_totalprice) AS count
FROM c WHERE month IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY month, o_orderstatus""")
def agg_monthly(spark, d):
    return monthly(spark, d).orderBy("month", "o_orderstatus")


def monthly(spark, d):
    o = table(spark, d, "orders").select(fx.month_label(F.col("o_orderdate").cast("timestamp")).alias("month"),
                                         "o_orderstatus", "o_totalprice")
    o = ag.cap_column(o, "o_totalprice", fx.WINSORIZE_THRESHOLD, "w")
    g = ag.drop_null_keys(o, ["month", "o_orderstatus"]).groupBy("month", "o_orderstatus").agg(
        F.avg("w").alias("mean_capped"), F.count("o_totalprice").alias("count"))
    return g.select("month", "o_orderstatus", r6("mean_capped").alias("mean_capped"), "count")


@register("agg_weekly_volume", """
WITH w AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS wk FROM orders WHERE o_orderdate IS NOT NULL),
spine AS (SELECT CAST(unnest(generate_series(min(wk), max(wk), INTERVAL 7 DAY)) AS DATE) AS wk FROM w),
c AS (SELECT wk, count(*) AS n FROM w GROUP BY wk)
SELECT strftime(spine.wk + INTERVAL 6 DAY, '%Y-%m-%d') AS week_end, COALESCE(c.n, 0) AS n_posts
FROM spine LEFT JOIN c ON spine.wk = c.wk""")
def agg_weekly_volume(spark, d):
    from postmetrics.operators.timeline import weekly_volume
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"))
    return weekly_volume(o, "ts").orderBy("week_end")


@register("agg_mode", """
SELECT user_id AS mode FROM (SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL
GROUP BY user_id ORDER BY n DESC, user_id LIMIT 1)""")
def agg_mode(spark, d):
    return ag.mode_value(table(spark, d, "events"), "user_id", "mode")


@register("agg_engagement_by_label", """
SELECT l.quality, round_even(avg(d.n_chars), 0) AS mean_n_chars
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL GROUP BY l.quality""")
def agg_engagement_by_label(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", "quality")
    j = docs.join(lab, "doc_id")
    g = ag.drop_null_keys(j, ["quality"]).groupBy("quality").agg(round_half_even(F.avg("n_chars"), 0).alias("mean_n_chars"))
    return g.orderBy(F.desc("mean_n_chars"))


@register("agg_distinct_count", """
SELECT (SELECT count(DISTINCT user_id) FROM events) AS n_users,
       (SELECT count(DISTINCT event_id) FROM events) AS n_posts,
       (SELECT count(DISTINCT source) FROM documents) AS n_sources""")
def agg_distinct_count(spark, d):
    ev = table(spark, d, "events").agg(F.count_distinct("user_id").alias("n_users"),
                                       F.count_distinct("event_id").alias("n_posts"))
    docs = table(spark, d, "documents").agg(F.count_distinct("source").alias("n_sources"))
    return ev.select(F.col("n_users"), F.col("n_posts"), docs.scalar().alias("n_sources"))


@register("agg_row_counts", "WITH " + SQL_ENGINEERED + ", " + SQL_CORE + """
SELECT (SELECT count(*) FROM events) AS raw_rows, (SELECT count(*) FROM eng) AS engineered_rows,
       (SELECT count(*) FROM core) AS model_rows""")
def agg_row_counts(spark, d):
    raw = table(spark, d, "events")
    eng = engineered(spark, d)
    core = core_sample(eng)
    return raw.agg(F.count(F.lit(1)).alias("raw_rows")).select(
        "raw_rows",
        eng.agg(F.count(F.lit(1))).scalar().alias("engineered_rows"),
        core.agg(F.count(F.lit(1))).scalar().alias("model_rows"))
