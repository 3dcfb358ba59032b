"""Account batches from an external source, with a ledger of what became of each.

A batch is a group of ids that one call asks for.  Calls run inside tasks (concurrency = partitions); a
call that fails costs its batch only.  A run writes the records of its batches to a side folder,
then commits one ledger row per batch (batch, state, error, records) and the folder together, so a
killed run leaves nothing visible and its batches are asked for again.  A batch whose last ledger
row says ``done`` is skipped by every later run.
"""

from __future__ import annotations

import json
from typing import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmetrics.sources import sinks

Fetch = Callable[[Sequence[str]], Sequence[dict]]
_CALLS = "batch int, run int, state string, error string, records array<string>"


def _calls(spark: SparkSession, path: str) -> DataFrame:
    found = sinks.published(spark, path, "calls")
    return found if found is not None else spark.createDataFrame([], _CALLS)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """batch, attempts, state, error, records: the last state of every batch that was asked for."""
    calls = _calls(spark, path)
    last = F.max_by(F.struct("state", "error", F.size("records").alias("records")), "run")
    return calls.groupBy("batch").agg(F.count("*").alias("attempts"), last.alias("l")).select("batch", "attempts", "l.*")


def progress(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """One row: batches wanted, done, failed and not yet asked for."""
    batches = wanted.select("batch").distinct().join(ledger(spark, path), "batch", "left")
    return batches.agg(F.count("*").alias("batches"), F.count_if(F.col("state") == "done").alias("done"),
                       F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state").isNull()).alias("open"))


def fetch_batches(spark: SparkSession, wanted: DataFrame, fetch: Fetch, path: str, schema: str) -> DataFrame:
    """Ask for every batch of ``wanted`` (id string, batch int) that is not done; return ``fetched``.

    ``fetch`` gets the ids of one batch and returns their records (dicts), or raises.
    """
    before = ledger(spark, path)
    run_no = _calls(spark, path).agg(F.coalesce(F.max("run"), F.lit(0)) + 1).first()[0]
    todo = wanted.join(before.where("state = 'done'").select("batch"), "batch", "left_anti")

    def call(group: pd.DataFrame) -> pd.DataFrame:
        state, error, records = "done", None, []
        try:
            records = [json.dumps(r) for r in fetch(sorted(group["id"].tolist()))]
        except Exception as e:  # of the source: recorded, the next run asks again
            state, error = "failed", f"{type(e).__name__}: {e}"
        return pd.DataFrame({"batch": [int(group["batch"].iloc[0])], "run": [run_no], "state": [state], "error": [error], "records": [records]})

    # a batch has a bounded number of ids, so a group is small
    sinks.publish(todo.select("id", "batch").groupBy("batch").applyInPandas(call, _CALLS), path, "calls")
    return fetched(spark, path, schema)


def fetched(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """batch and the fields of ``schema`` of every record of the batches that are done."""
    calls = _calls(spark, path).where("state = 'done'")
    return calls.select("batch", F.explode("records").alias("r")).select("batch", F.from_json("r", schema).alias("r")).select("batch", "r.*")
