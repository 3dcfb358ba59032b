"""Calendar series: gap-filled weekly volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_volume(df: DataFrame, ts: str, name: str = "n_posts") -> DataFrame:
    """Rows per calendar week (weeks end on Sunday); weeks without rows count 0.

    The spine is generated from the min/max week (one row per week of the
    covered span, independent of the row count) and left-joined to the counts.
    """
    wk = df.select(F.to_date(F.date_trunc("week", F.col(ts))).alias("wk")).where(F.col("wk").isNotNull())
    counts = wk.groupBy("wk").agg(F.count(F.lit(1)).alias("_n"))
    spine = (wk.agg(F.min("wk").alias("_a"), F.max("wk").alias("_b"))
             .where(F.col("_a").isNotNull())
             .select(F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 7 DAYS"))).alias("wk")))
    return (spine.join(counts, "wk", "left")
            .select(F.date_add("wk", 6).cast("string").alias("week_end"),
                    F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias(name)))
