"""Invariants: partition-count independence, strata partition the rows, thread roots are idempotent."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from postmetrics.operators import strata as st
from postmetrics.operators.ordinal import with_global_index, with_group_position
from postmetrics.operators.quantiles import quantiles
from postmetrics.operators.threads import thread_roots

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st_.lists(st_.tuples(st_.integers(0, 3), st_.integers(-5, 5)), min_size=1, max_size=60),
       st_.sampled_from([1, 3, 13]))
def test_positions_independent_of_partitioning(spark, rows, parts):
    data = [(i, g, v) for i, (g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, g int, v int")
    a = {r.id: (r._pos, r._n) for r in with_group_position(df.repartition(parts), ["g"], ["v", "id"]).collect()}
    b = {r.id: (r._pos, r._n) for r in with_group_position(df.coalesce(1), ["g"], ["v", "id"]).collect()}
    assert a == b
    idx = sorted(r._idx for r in with_global_index(df.repartition(parts), [F.col("v"), F.col("id")]).collect())
    assert idx == list(range(len(data)))


@SETTINGS
@given(st_.lists(st_.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=80))
def test_sort_and_builtin_quantiles_agree(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    a = quantiles(df, "v", [0.1, 0.5, 0.95], method="sort").first()
    b = quantiles(df, "v", [0.1, 0.5, 0.95], method="builtin").first()
    c = quantiles(df, "v", [0.1, 0.5, 0.95], method="radix").first()
    for x, y, z in zip(a, b, c):
        assert abs(x - y) <= 1e-9 * max(1.0, abs(y))
        assert abs(z - y) <= 1e-9 * max(1.0, abs(y))


@SETTINGS
@given(st_.integers(0, 57))
def test_strata_partition_rows(spark, n):
    rnd = random.Random(n)
    df = spark.createDataFrame([(i, float(rnd.randint(0, 5))) for i in range(n)], "id long, v double")
    got = st.quartile_strata(df, "v", "id").groupBy("stratum").count().collect()
    assert sum(r["count"] for r in got) == n


def test_thread_roots_idempotent(spark):
    rnd = random.Random(7)
    ids = [f"p{i:03d}" for i in range(200)]
    rows = [(n, ids[rnd.randrange(i)] if i and rnd.random() < 0.6 else
             (f"gone{rnd.randrange(5)}" if rnd.random() < 0.3 else None)) for i, n in enumerate(ids)]
    df = spark.createDataFrame(rows, "id string, parent string")
    first = {r.id: r.thread_id for r in thread_roots(df, "id", "parent").collect()}
    again_rows = [(i, None if first[i] == i else first[i]) for i in ids]
    again = {r.id: r.thread_id for r in thread_roots(spark.createDataFrame(again_rows, "id string, parent string"),
                                                     "id", "parent").collect()}
    assert again == first
