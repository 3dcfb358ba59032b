"""postmetrics: post-engagement analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources    readers for archive exports, CSV / JSON side files, driver tables; sinks
functions  Column expressions for per-post features (no Python UDFs)
operators  aggregates, ordinal/quantile toolkit, strata, threads, network, labels
stats      design matrices and regressions computed from distributed sums
plans      the query catalogue registered in ``__spark_entry__``
streaming  incremental (resumable) labelling with Structured Streaming
"""

from postmetrics.session import build_session, scratch_path  # noqa: F401

__version__ = "0.1.0"
