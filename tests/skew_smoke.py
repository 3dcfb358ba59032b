"""Skew smoke run (not part of pytest): one key holds a third of the rows, one very deep thread.

usage: python tests/skew_smoke.py [rows]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from postmetrics.operators import aggregates as ag  # noqa: E402
from postmetrics.operators.ordinal import with_group_position  # noqa: E402
from postmetrics.operators.threads import thread_roots  # noqa: E402
from postmetrics.session import build_session  # noqa: E402


def timed(label, fn):
    t = time.time()
    out = fn()
    print(f"{label}: {time.time() - t:.1f}s", flush=True)
    return out


def main():
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000
    spark = build_session("local[8]", 32)
    df = spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000 + 1).alias("g"),
        (F.rand(7) * 1e6).alias("v"))
    stats = timed("group_stats with exact medians (hot group, high-cardinality doubles)",
                  lambda: ag.group_stats(df, ["g"], "v").where("g = 0").collect())
    print(stats)
    timed("positions inside groups", lambda: with_group_position(df, ["g"], ["v", "id"]).where("_pos = 0").count())
    depth = n // 15
    chain = spark.range(depth).select(F.col("id").cast("string").alias("id"),
                                      F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"))
    roots = timed(f"thread roots of a {depth}-deep chain",
                  lambda: thread_roots(chain, "id", "parent").groupBy("thread_id").count().collect())
    print(roots)


if __name__ == "__main__":
    main()
