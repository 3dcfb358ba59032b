"""Distributed operators against brute-force Python on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmetrics.operators import aggregates as ag
from postmetrics.operators import network as nw
from postmetrics.operators import strata as st
from postmetrics.operators.ordinal import with_global_index, with_group_position
from postmetrics.operators.quantiles import quantiles
from postmetrics.operators.threads import thread_roots


def test_global_index_matches_sort(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 20)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    got = {r.id: r._idx for r in with_global_index(df, [F.col("v").desc(), F.col("id")]).collect()}
    expect = {id_: pos for pos, (id_, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == expect


def test_group_position_with_hot_group(spark):
    rows = [(0 if i % 3 else i % 5, i, float(i % 11)) for i in range(600)]  # group 0 holds most rows
    df = spark.createDataFrame(rows, "g long, id long, t double")
    got = {(r.g, r.id): (r._pos, r._n) for r in with_group_position(df, ["g"], ["t", "id"]).collect()}
    for g in {r[0] for r in rows}:
        members = sorted([r for r in rows if r[0] == g], key=lambda r: (r[2], r[1]))
        for pos, r in enumerate(members):
            assert got[(g, r[1])] == (pos, len(members))


@pytest.mark.parametrize("method", ["builtin", "sort", "radix"])
def test_quantiles_match_numpy(spark, method):
    rnd = random.Random(5)
    rows = [("hot" if i % 2 else f"g{i % 4}", rnd.choice([None, rnd.random() * 100, 7.0])) for i in range(400)]
    rows += [("single", 3.5), ("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.q25, r.q50, r.q95) for r in
           quantiles(df, "v", [0.25, 0.5, 0.95], ["g"], ["q25", "q50", "q95"], method).collect()}
    for g in {r[0] for r in rows}:
        vals = [v for k, v in rows if k == g and v is not None]
        if not vals:
            assert got[g] == (None, None, None)
            continue
        exp = np.percentile(vals, [25, 50, 95])
        assert np.allclose(got[g], exp, rtol=1e-12, atol=1e-12)


def test_scalar_quantile_all_equal_and_empty(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "v double")
    assert quantiles(df, "v", [0.95], method="sort").first()[0] == 2.0
    empty = spark.createDataFrame([], "v double")
    assert quantiles(empty, "v", [0.95], method="sort").first()[0] is None


def test_group_stats_drops_null_keys_and_single_row_std(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 9.0)], "k string, v double")
    got = {r.k: r for r in ag.group_stats(df, ["k"], "v").collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["count"] == 2 and got["a"]["median"] == 2.0
    assert got["b"]["std"] is None


def _walk_roots(edges, ids):
    """Sequential reference walk: follow parents while the node is a reply; cycles -> smallest id."""
    roots = {}
    for start in ids:
        path, cur, seen = [start], start, {start}
        while cur in edges:
            cur = edges[cur]
            if cur in seen:
                cyc = path[path.index(cur):]
                roots[start] = min(cyc)
                break
            path.append(cur)
            seen.add(cur)
        else:
            roots[start] = path[-1]
    return roots


def test_threads_edge_cases(spark):
    rows = [("a1", None), ("a2", "a1"), ("a3", "a2"), ("a4", "a3"), ("a5", "a4"),   # chain of 5
            ("b2", "b1"), ("b3", "b2"),                                              # root missing
            ("c1", None), ("c2", "c1"), ("c3", "c1"),                                # two children
            ("d1", "d1"),                                                            # self-parent
            ("e1", "e2"), ("e2", "e1")]                                              # 2-cycle
    df = spark.createDataFrame(rows, "id string, parent string")
    got = {r.id: r.thread_id for r in thread_roots(df, "id", "parent").collect()}
    assert got["a5"] == "a1" and got["a1"] == "a1"
    assert got["b3"] == "b1" and got["b2"] == "b1"
    assert got["c2"] == got["c3"] == "c1"
    assert got["d1"] == "d1"
    assert got["e1"] == got["e2"] == "e1"


def test_threads_duplicate_id_latest_row_wins(spark):
    rows = [("x", "p_old", 1), ("x", "p_new", 2), ("p_new", None, 0), ("p_old", None, 0)]
    df = spark.createDataFrame(rows, "id string, parent string, seq int")
    got = {r.id: r.thread_id for r in thread_roots(df, "id", "parent", ["seq"]).collect()}
    assert got["x"] == "p_new"


def test_threads_random_forests_match_walk(spark):
    rnd = random.Random(11)
    ids = [f"n{i:04d}" for i in range(800)]
    edges = {}
    for i, n in enumerate(ids):
        r = rnd.random()
        if i and r < 0.7:
            edges[n] = ids[rnd.randrange(0, i)]          # parent archived
        elif r < 0.8:
            edges[n] = f"missing{rnd.randrange(50)}"     # parent outside the archive
    # a few cycles
    edges["n0001"], edges["n0002"] = "n0002", "n0001"
    rows = [(n, edges.get(n)) for n in ids]
    df = spark.createDataFrame(rows, "id string, parent string")
    got = {r.id: r.thread_id for r in thread_roots(df, "id", "parent").collect()}
    assert got == _walk_roots(edges, ids)


def test_strata_floor_bounds(spark):
    for n in (0, 1, 3, 10, 17):
        df = spark.createDataFrame([(i, float(n - i)) for i in range(n)], "id long, v double")
        got = sorted((r.id, r.stratum) for r in st.quartile_strata(df, "v", "id").collect())
        bounds = (n // 4, n // 2, 3 * n // 4)
        expect = sorted((i, 1 + sum(i >= b for b in bounds)) for i in range(n))
        assert got == expect


def test_stratified_sample_sizes(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "id long, s int")
    got = st.stratified_sample(df, "s", "id", 10).groupBy("s").count().collect()
    assert sorted(r["count"] for r in got) == [10, 10, 10]
    small = st.stratified_sample(df.where("id < 4"), "s", "id", 10).count()
    assert small == 4


def test_network_summary_guards(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "account_id long")
    empty = nw.network_summary(ids([]), ids([])).first()
    assert empty.total_mutual == 0 and empty.pct_following_back == 0.0 and empty.follow_ratio == 0.0
    same = nw.network_summary(ids([1, 2]), ids([1, 2])).first()
    assert same.pct_following_back == 100.0 and same.pct_followed_back == 100.0
    disjoint = nw.network_summary(ids([1]), ids([2])).first()
    assert disjoint.pct_following_back == 0.0 and disjoint.following_only == 1


def test_dedupe_keep_first(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, 1, "c")], "k long, o long, x string")
    got = sorted(tuple(r) for r in st.dedupe_keep_first(df, ["k"], ["o"]).collect())
    assert got == [(1, 3, "a"), (2, 1, "c")]


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (1,), (2,), (None,), (None,), (None,)], "x long")
    assert ag.mode_value(df, "x").first()[0] == 1


def test_radix_quantiles_large_group_exact(spark):
    rnd = np.random.default_rng(9)
    vals = np.concatenate([rnd.normal(size=60000), np.full(20000, 1.5)])   # many ties in one spot
    groups = np.where(np.arange(len(vals)) % 5 == 0, "small", "hot")
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({"g": groups, "v": vals}))
    got = {r.g: (r.a, r.b, r.c) for r in quantiles(df, "v", [0.05, 0.5, 0.99], ["g"], ["a", "b", "c"],
                                                 method="radix").collect()}
    for g in ("small", "hot"):
        exp = np.percentile(vals[groups == g], [5, 50, 99])
        assert np.allclose(got[g], exp, rtol=1e-12, atol=1e-12)


def test_select_rows_exact_with_ties(spark):
    from postmetrics.operators.ordinal import select_rows
    rnd = random.Random(2)
    rows = [(float(rnd.choice([1, 2, 2, 2, 3, 5])), i) for i in range(30000)]
    df = spark.createDataFrame(rows, "k double, id long")
    ordered = sorted(rows)
    positions = [0, 7500, 15000, 22499, 29999]
    got = select_rows(df, "k", "id", positions)
    assert got == [ordered[p] for p in positions]


def test_radix_quantiles_null_group(spark):
    rows = [(None, float(i)) for i in range(50)] + [("a", float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.m for r in quantiles(df, "v", [0.5], ["g"], ["m"], method="radix").collect()}
    assert got == {None: 24.5, "a": 4.5}


def test_with_previous_matches_python(spark):
    from postmetrics.operators.ordinal import with_previous
    rnd = random.Random(4)
    rows = [(i, rnd.randint(0, 50), f"v{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "id long, t long, val string").repartition(5)
    got = {r.id: r.prev_val for r in with_previous(df, [F.col("t"), F.col("id")], ["val"]).collect()}
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    expect = {r[0]: (ordered[i - 1][2] if i else None) for i, r in enumerate(ordered)}
    assert got == expect


def test_sample_is_spread_over_ids(spark):
    """Sampled ids of three million dense ones: spread over the range and over residues."""
    from postmetrics.operators.strata import stratified_sample
    df = spark.range(3_200_000).select(F.col("id"), F.lit(1).alias("s"))
    ids = sorted(r.id for r in stratified_sample(df, "s", "id", 125).collect())
    assert len(ids) == 125 and len({i % 1_000_003 for i in ids}) == 125
    assert all(15 <= sum(lo <= i < lo + 800_000 for i in ids) <= 50 for lo in range(0, 3_200_000, 800_000))


def test_cycles_of_any_length_beside_chains(spark):
    from postmetrics.operators.threads import thread_roots
    edges = [(f"a{i}", f"a{(i + 1) % 7}") for i in range(7)] + [("b0", "b1"), ("b1", "b0"), ("t0", "t1"), ("t1", "a3")]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    df = spark.createDataFrame(edges + [("c060", None)], "id string, parent string")
    got = {r.id: r.thread_id for r in thread_roots(df, "id", "parent").collect()}
    assert all(got[f"a{i}"] == "a0" for i in range(7)) and got["b0"] == got["b1"] == "b0" and got["t0"] == got["t1"] == "a0"
    assert {v for k, v in got.items() if k[0] == "c"} == {"c060"}


def test_entity_demean_sorts_no_rows(spark, capsys):
    """The means of a task's entities stay in memory, not its rows."""
    from postmetrics.operators.joins import entity_demean
    df = spark.range(1000).select((F.col("id") % 7).alias("e"), F.col("id").cast("double").alias("x"))
    out = entity_demean(df, "e", ["x"], add_grand_mean=False)
    out.explain()
    plan = capsys.readouterr().out
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    sums = out.groupBy("e").agg(F.sum("x").alias("s")).collect()
    assert len(sums) == 7 and all(abs(r.s) < 1e-6 for r in sums)
