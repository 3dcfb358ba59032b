"""Driver tables and the post-shaped views derived from them.

All readers go through ``spark.read.parquet`` so Catalyst prunes columns and
pushes filters into the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def posts(spark: SparkSession, sf_dir: str, parse_once: bool = False) -> DataFrame:
    """Post-like view of ``events``.

    post_id = event_id, author_id = user_id, post_datetime = ts (UTC instant),
    category = event_type, engagement = value, k = props.k.

    As an expression, ``k`` is dropped where nothing reads it, but a filter over columns made from
    it is pushed down with one JSON parse for every mention; with ``parse_once`` it is a generator's
    output, which filters stay above.
    """
    ev = table(spark, sf_dir, "events")
    columns = [F.col("event_id").alias("post_id"), F.col("user_id").alias("author_id"), F.col("ts").cast("timestamp").alias("post_datetime"),
               F.col("event_type").alias("category"), F.col("value").alias("engagement")]
    if not parse_once:
        return ev.select(*columns, F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    rows = ev.select(*columns, F.json_tuple("props", "k").alias("_k"))
    return rows.select("post_id", "author_id", "post_datetime", "category", "engagement", F.col("_k").try_cast("bigint").alias("k"))
