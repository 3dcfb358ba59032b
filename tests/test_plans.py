"""Physical-plan guards: pruned scans, pushed predicates, no cartesian products."""

import pytest

SF = "/root/testdata/sf0.001"


def _plan(spark, key):
    import __spark_entry__ as E
    df = E.queries()[key](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_reads_two_columns(spark):
    plan = _plan(spark, "agg_group_stats")
    assert "ReadSchema: struct<event_type:string,value:double>" in plan.replace("\n", " ") or \
        "struct<event_type:string,value:double>" in plan


def test_event_window_pushes_time_range(spark):
    plan = _plan(spark, "filt_event_window")
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


@pytest.mark.parametrize("key", ["agg_advantage_top2", "join_scalar_threshold", "agg_network_summary",
                                 "win_quartile_strata", "join_owner_lookup", "agg_row_counts"])
def test_no_cartesian_products(spark, key):
    plan = _plan(spark, key)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("key", ["proj_is_retweet", "proj_is_quote", "proj_is_reply"])
def test_row_flags_move_no_rows(spark, key):
    assert "Exchange" not in _plan(spark, key)


def test_archive_is_scanned_once(spark):
    assert _plan(spark, "scan_posts_json").count("FileScan json") == 1


def _jobs(spark, action):
    group = f"plans-{id(action)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(tracker.getJobInfo(j).stageIds[-1]) for j in tracker.getJobIdsForGroup(group)]
    return out, sum(not (s and s.name.startswith("parquet at")) for s in stages)  # without reads of table schemas


@pytest.mark.parametrize("key", ["proj_reply_type", "agg_bool_sum", "agg_row_counts", "agg_value_counts", "filt_core_sample",
                                 "filt_with_quotes", "proj_head_columns", "label_posts", "agg_network_by_account"])
def test_no_job_while_the_plan_is_built(spark, key):
    import __spark_entry__ as E
    query = E.queries()[key]
    assert _jobs(spark, lambda: query(spark, SF))[1] == 0


def test_a_capped_column_does_not_carry_its_quantile(spark):
    plan = _plan(spark, "agg_group_stats")
    assert plan.count("FileScan parquet") == 1 and "Subquery" not in plan


def test_quantiles_scan_at_most_four_times(spark):
    from postmetrics.operators.quantiles import quantiles
    many = spark.range(60_000).selectExpr("id % 20000 AS g", "CAST(id * 7919 % 60000 AS DOUBLE) / 7 AS v")
    few, jobs = _jobs(spark, lambda: quantiles(many.where("g < 5"), "v", [0.5], ["g"]))
    assert few.count() == 5
    lazy = quantiles(many, "v", [0.5], ["g"], ["m"])
    assert lazy._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 60000") <= 9
    want = {r.g: r.m for r in quantiles(many, "v", [0.5], ["g"], ["m"], method="builtin").collect()}
    assert {r.g: r.m for r in lazy.collect()} == want


@pytest.mark.parametrize("key", ["label_posts", "label_posts_multi", "join_truth_pairs", "eval_labelers"])
def test_rule_labelling_has_no_python_node(spark, key):
    plan = _plan(spark, key)
    assert "MapInPandas" not in plan and "MapInArrow" not in plan and "Python" not in plan


def test_lag_has_one_exchange(spark, monkeypatch):
    from postmetrics.operators import ordinal
    plans = []
    write = ordinal.materialize
    monkeypatch.setattr(ordinal, "materialize", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    df = spark.range(1000).selectExpr("id * 7919 % 1000 AS k", "id AS v").repartition(5)
    out = ordinal.with_previous(df, ["k"], ["v"])
    assert sorted((r.k, r.v, r.prev_v) for r in out.collect())[1:3] == [(1, 679, 0), (2, 358, 679)]
    assert plans[0].count("rangepartitioning") == 1 and "hashpartitioning" not in plans[0].replace("REPARTITION_BY_NUM", "")
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert ordinal.with_previous(df.limit(0), ["k"], ["v"]).collect() == []


def test_samples_are_cut_in_the_tasks(spark):
    from postmetrics.operators import strata
    df = spark.range(5000).selectExpr("id", "CAST(id % 3 AS STRING) AS s")
    plan = strata.stratified_sample(df, "s", "id", {"0": 5, "1": 2})._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    small = strata.stratified_sample(df, "s", "id", {"0": 5, "1": 2})
    got = {(r.s, r.id, r["_pos"]) for r in small.collect()}
    keyed = df.withColumn("_key", strata.seeded_key("id", 42))
    same = {(r.s, r.id, r["_pos"]) for r in strata._thresholded(keyed, "s", "id", {"0": 5, "1": 2}, "_pos", 4.0).collect()}
    assert got == same and len(got) == 7
