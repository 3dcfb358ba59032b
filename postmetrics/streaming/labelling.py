"""Incremental, resumable labelling with Structured Streaming.

The reference labels posts in batches and, when re-run, skips batches whose
output already exists.  Spark's native form of that is a streaming query over
the directory where new post files land: the file source remembers which files
were consumed, the parquet sink commits each micro-batch exactly once, and both
live under one checkpoint location.  ``trigger(availableNow=True)`` processes
everything pending and stops, so the job can run on a schedule; after a crash
it resumes from the last committed micro-batch.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from postmetrics.operators.labels import Labeler, label_posts
from postmetrics.session import ensure_checkpoint_dir


def label_stream(spark: SparkSession, source_dir: str, schema: str, out_dir: str, id_col: str, text_col: str,
                 labeler: Labeler | None = None, checkpoint: str | None = None, files_per_trigger: int | None = None,
                 source_format: str = "parquet") -> StreamingQuery:
    """Start (and return) the labelling stream; call ``awaitTermination()`` to wait for it."""
    if checkpoint is None:
        checkpoint = os.path.join(ensure_checkpoint_dir(spark), "streams", os.path.basename(out_dir.rstrip("/")))
    reader = spark.readStream.schema(schema).format(source_format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    posts = reader.load(source_dir)
    labelled = label_posts(posts, id_col, text_col, labeler)
    return (labelled.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(out_dir))
