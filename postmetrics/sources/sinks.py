"""Sinks: partitioned parquet, CSV with header, JSON lines, text; published tables and resumable batches.

Writers are plain ``DataFrameWriter`` calls (executors write in parallel, the
driver only commits).  A *published table* is a folder with ``data/<append>`` and a ``manifest``:
an append first writes its rows to a side folder, then adds one manifest file that names it (one
file, so visible as a whole or not at all).  Readers follow the manifest, so rows of an append that
was killed in between are never seen.  Resume is a ``left_anti`` join of the wanted rows against the
published ones, then an append of the rest.
"""

from __future__ import annotations

import uuid
from typing import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmetrics.session import path_exists


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    # the writer trims values by default; texts must round-trip unchanged
    (df.write.mode(mode).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).json(path)
    return path


def write_text_lines(df: DataFrame, col: str, path: str, mode: str = "overwrite") -> str:
    """One value per line (the distributed form of a comma-joined id list)."""
    df.select(F.col(col).cast("string").alias("value")).write.mode(mode).text(path)
    return path


def existing(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    return spark.read.format(fmt).load(path) if path_exists(spark, path) else None


MANIFEST_DDL = "folder string, kind string, batches array<string>"


def _write_side(df: DataFrame, path: str) -> str:
    """The rows in a folder that no manifest names yet."""
    folder = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    return folder


def _commit(spark: SparkSession, path: str, folder: str, kind: str = "rows", batches: Sequence[str] = ()) -> None:
    """Name a written folder in the manifest: one row, one file."""
    row = spark.createDataFrame([(folder, kind, list(batches))], MANIFEST_DDL)
    row.coalesce(1).write.mode("append").json(f"{path}/manifest")


def publish(df: DataFrame, path: str, kind: str = "rows") -> str:
    """Append ``df`` to the published table at ``path``: all of its rows become visible at once."""
    folder = _write_side(df, path)
    _commit(df.sparkSession, path, folder, kind)
    return folder


def published(spark: SparkSession, path: str, kind: str = "rows") -> DataFrame | None:
    """The visible rows of a published table; None before the first append.

    The manifest has one row per append, which the driver reads to know the folders.
    """
    if not path_exists(spark, f"{path}/manifest"):
        return None
    rows = spark.read.schema(MANIFEST_DDL).json(f"{path}/manifest").where(F.col("kind") == kind).select("folder").collect()
    folders = sorted(f"{path}/{r['folder']}" for r in rows)
    return spark.read.parquet(*folders) if folders else None


def resume_batches(spark: SparkSession, wanted: DataFrame, batch_col: str, path: str,
                   produce: Callable[[DataFrame], DataFrame], key_cols: Sequence[str] | None = None,
                   groups: int = 1) -> tuple[DataFrame, list[tuple[int, str]]]:
    """Publish only the rows not yet visible at ``path``; return (all rows, failed groups).

    Rows count as done by their key (``key_cols``, the columns of ``wanted`` if None), so a batch
    that an earlier run left half done is completed.  ``produce`` turns the missing wanted rows
    into output rows that carry the key and ``batch_col``.  Batches are dealt into ``groups``
    appends, each published as a whole; a group whose job fails is recorded with its error and left
    out, the others go on, and the next run takes it up again.  Errors that are neither of a Spark job
    nor of input and output, and the failure of every group, are raised.  Batches are a column, not
    folders.  Plain parquet files at ``path`` are taken over as the first append.
    """
    keys = list(key_cols or wanted.columns)
    if published(spark, path) is None and existing(spark, f"{path}/*.parquet") is not None:
        _commit(spark, path, "*.parquet")
    done = published(spark, path)
    todo = wanted if done is None else wanted.join(done.select(*keys).distinct(), keys, "left_anti")
    failed, last = [], None
    for g in range(groups):
        part = todo.where(F.pmod(F.xxhash64(batch_col), F.lit(groups)) == g) if groups > 1 else todo
        try:
            publish(produce(part), path)
        except (Py4JJavaError, PySparkException, OSError) as e:  # the next group goes on
            failed.append((g, str(e).splitlines()[0]))
            last = e
    if len(failed) == groups:
        raise last
    return published(spark, path), failed
