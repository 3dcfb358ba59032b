"""Follow-graph reciprocity: mutuals, exclusive counts, ratios and insight rules.

Id lists are distinct DataFrames; intersections are semi joins (a shuffle on
the id, map-side distinct first), counts are partial aggregates, so neither
list is ever collected.  Per-account versions add the account key to the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed thresholds and sentences of the insight rules (reference report values).
RECIPROCITY_LOW = 30
RECIPROCITY_HIGH = 70
FOLLOWED_BACK_LOW = 20
FOLLOWED_BACK_HIGH = 50
RATIO_INFLUENCER = 2
RATIO_CONSUMER = 0.5


def relation_ids(df: DataFrame, struct_col: str, id_field: str = "accountId", name: str = "account_id") -> DataFrame:
    """Distinct ids of an archive relation list (``following`` / ``follower`` records)."""
    return df.select(F.col(f"{struct_col}.{id_field}").alias(name)).where(F.col(name).isNotNull()).distinct()


def mutuals(following: DataFrame, followers: DataFrame, key: str = "account_id") -> DataFrame:
    return following.select(key).join(followers.select(key), key, "left_semi").distinct()


def mutuals_by_account(following: DataFrame, followers: DataFrame, account: str = "account_id", other: str = "other_id") -> DataFrame:
    """Distinct (account, other) pairs that stand in both lists.

    Both sides are reduced to distinct pairs first (partial aggregates), then semi-joined on the pair:
    an account with most of the edges is spread over all partitions, since its pairs differ.
    """
    pairs = [df.select(account, other).where(F.col(account).isNotNull() & F.col(other).isNotNull()).distinct()
             for df in (following, followers)]
    return pairs[0].join(pairs[1], [account, other], "left_semi")


def network_summary_by_account(following: DataFrame, followers: DataFrame, account: str = "account_id", other: str = "other_id") -> DataFrame:
    """``network_summary`` for every account of either list."""
    sides = [df.select(account, other).where(F.col(account).isNotNull() & F.col(other).isNotNull()).distinct().withColumn(name, F.lit(1))
             for df, name in ((following, "_a"), (followers, "_b"))]
    both = sides[0].join(sides[1], [account, other], "full_outer")
    s = both.groupBy(account).agg(
        F.count("_a").alias("total_following"), F.count("_b").alias("total_followers"),
        F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("total_mutual"))
    return s.select(account, *_summary_columns())


def network_summary(following: DataFrame, followers: DataFrame, key: str = "account_id") -> DataFrame:
    """One row: totals, mutual, follow-back shares (%), ratio and exclusive counts (0 guards)."""
    a = following.select(key).distinct().withColumn("_a", F.lit(1))
    b = followers.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full_outer")
    s = both.agg(
        F.count(F.col("_a")).alias("total_following"),
        F.count(F.col("_b")).alias("total_followers"),
        F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("total_mutual"))
    return s.select(*_summary_columns())


def _summary_columns() -> list[Column]:
    fol, fer, mut = F.col("total_following"), F.col("total_followers"), F.col("total_mutual")
    return [fol.alias("total_following"), fer.alias("total_followers"), mut.alias("total_mutual"),
            _pct(mut, fol).alias("pct_following_back"), _pct(mut, fer).alias("pct_followed_back"),
            F.when(fol > 0, fer / fol).otherwise(F.lit(0.0)).alias("follow_ratio"),
            (fol - mut).alias("following_only"), (fer - mut).alias("followers_only")]


def _pct(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den * F.lit(100.0)).otherwise(F.lit(0.0))


def rule_insights(summary: DataFrame) -> DataFrame:
    """Insight lines from the rule table, one row per fired rule."""
    r, fb, ratio = F.col("pct_following_back"), F.col("pct_followed_back"), F.col("follow_ratio")
    fmt1 = lambda c: F.format_number(c, 1)
    fmt2 = lambda c: F.format_number(c, 2)
    reciprocity = (F.when(r < RECIPROCITY_LOW, F.struct(F.lit("reciprocity"), F.lit("low"), fmt1(r)))
                   .when(r > RECIPROCITY_HIGH, F.struct(F.lit("reciprocity"), F.lit("high"), fmt1(r)))
                   .otherwise(F.struct(F.lit("reciprocity"), F.lit("moderate"), fmt1(r))))
    followed = (F.when(fb < FOLLOWED_BACK_LOW, F.struct(F.lit("followed_back"), F.lit("selective"), fmt1(fb)))
                .when(fb > FOLLOWED_BACK_HIGH, F.struct(F.lit("followed_back"), F.lit("high"), fmt1(fb))))
    ratio_rule = (F.when(ratio > RATIO_INFLUENCER, F.struct(F.lit("follow_ratio"), F.lit("influencer"), fmt2(ratio)))
                  .when(ratio < RATIO_CONSUMER, F.struct(F.lit("follow_ratio"), F.lit("consumer"), fmt2(ratio))))
    direction = (F.when(ratio > 1, F.struct(F.lit("direction"), F.lit("more_followers"), fmt2(ratio)))
                 .when(ratio < 1, F.struct(F.lit("direction"), F.lit("more_following"),
                                          fmt2(F.when(ratio > 0, F.lit(1.0) / ratio))))
                 .otherwise(F.struct(F.lit("direction"), F.lit("equal"), fmt2(ratio))))
    lines = F.array_compact(F.array(reciprocity, followed, ratio_rule, direction))
    return (summary.select(F.explode(lines).alias("x"))
            .select(F.col("x.col1").alias("rule"), F.col("x.col2").alias("level"), F.col("x.col3").alias("value")))
