"""Intermediate tables in the shared scratch folder, and their removal.

Lineage is cut by writing a table below ``spark.checkpoint.dir``; a lost executor then costs only
the tasks it ran, never an earlier phase.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from postmetrics.session import scratch_path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and return a scan of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that no later phase reads."""
    for df in tables:
        spark = df.sparkSession
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of phases whose frames are no longer used."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def prefer_small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
