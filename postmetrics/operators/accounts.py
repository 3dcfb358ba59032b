"""Many accounts in one frame: owner, cap and period boundaries as a keyed dimension.

Everything that is a scalar for one archive (its owner, the cap of its engagement, the dates of its
tiers) becomes a column of a table with one row per account, joined back by the account.  The
dimension is built from partial aggregates, so an account that holds most of the posts costs one
buffer per task; the join back is left to AQE, which broadcasts a small dimension and splits
the partitions of a hot account otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmetrics.functions import features as fx
from postmetrics.operators.quantiles import quantiles

HINTED, AUTHOR, REPLIED = range(3)


def owners(posts: DataFrame, account: str, author: str, screen_name: str, reply_to: str, hints: DataFrame | None = None) -> DataFrame:
    """account, owner_id: per account the most frequent author under the hinted screen name, else the
    most frequent author, else the most frequent reply target; ties to the smaller id, NULL without any.

    ``hints``: one row (account, screen_name) for each account that has a hint.
    """
    rows = posts.select(F.col(account).alias("account"), F.col(author).cast("string").alias("author"),
                        F.col(screen_name).cast("string").alias("screen"), F.col(reply_to).cast("string").alias("target"))
    hinted: Column = F.lit(False)
    if hints is not None:
        named = hints.select(F.col("account").alias("_a"), F.col("screen_name").alias("_hint"))
        rows = rows.join(named, F.col("account").eqNullSafe(F.col("_a")), "left")
        hinted = fx.ci_equal("screen", "_hint")
    # every post votes for its author (once more if the name fits the hint) and for its reply target
    votes = F.array(F.struct(F.lit(AUTHOR).alias("rank"), F.col("author").alias("id")),
                    F.struct(F.lit(REPLIED).alias("rank"), F.col("target").alias("id")),
                    F.struct(F.lit(HINTED).alias("rank"), F.when(hinted, F.col("author")).alias("id")))
    counts = rows.select("account", F.explode(votes).alias("v")).groupBy("account", "v.rank", "v.id").agg(F.count("*").alias("n"))
    best = F.min_by("id", F.when(F.col("id").isNotNull(), F.struct("rank", -F.col("n"), "id")))
    return counts.groupBy("account").agg(best.alias("owner_id"))


def account_dimension(posts: DataFrame, account: str, value: str, owner: DataFrame, boundaries: DataFrame | None = None,
                      cap_q: float = fx.WINSORIZE_THRESHOLD, tier_start: str = fx.TIER_UPGRADED_START,
                      tier_end: str = fx.TIER_POST_UPGRADE_START, required: bool = False) -> DataFrame:
    """account, owner_id, cap, tier_start, tier_end: one row per account of ``posts``.

    ``owner`` is the table of ``owners``; ``boundaries`` (account, tier_start, tier_end as timestamps)
    overrides the two dates for the accounts it holds.  With ``required`` an account without owner
    fails the job when it is read, as a single archive without owner does.
    """
    caps = quantiles(posts.select(F.col(account).alias("account"), F.col(value).alias("_v")), "_v", [cap_q], ["account"], ["cap"])
    named = owner.select(F.col("account").alias("_a"), "owner_id")
    dim = caps.join(named, F.col("account").eqNullSafe(F.col("_a")), "left").drop("_a")
    start, end = F.to_timestamp(F.lit(tier_start)), F.to_timestamp(F.lit(tier_end))
    if boundaries is not None:
        own = boundaries.select(F.col("account").alias("_b"), F.col("tier_start").alias("_s"), F.col("tier_end").alias("_e"))
        dim = dim.join(own, F.col("account").eqNullSafe(F.col("_b")), "left")
        start, end = F.coalesce("_s", start), F.coalesce("_e", end)
    who = F.col("owner_id")
    if required:
        missing = F.raise_error(F.concat(F.lit("no owner can be inferred for account "), F.coalesce(F.col("account").cast("string"), F.lit("NULL"))))
        who = F.coalesce(who, missing.cast("string"))
    return dim.select("account", who.alias("owner_id"), "cap", start.alias("tier_start"), end.alias("tier_end"))


def with_account_features(posts: DataFrame, dimension: DataFrame, account: str, reply_to: str, time: str, value: str) -> DataFrame:
    """``posts`` with owner_id, reply_type, account_tier and winsorized, each by the row's own account."""
    dim = dimension.select(F.col("account").alias("_key"), "owner_id", "cap", "tier_start", "tier_end")
    joined = posts.join(dim, F.col(account).eqNullSafe(F.col("_key")), "left")
    return joined.select(
        *[posts[c] for c in posts.columns], "owner_id", fx.reply_type(reply_to, "owner_id").alias("reply_type"),
        fx.account_tier(time, F.col("tier_start"), F.col("tier_end")).alias("account_tier"),
        fx.winsorize(value, F.col("cap")).alias("winsorized"))
