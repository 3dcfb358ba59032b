"""Models against numpy, label validation, archive shapes (invented fixtures)."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postmetrics.operators import labels as lb
from postmetrics.operators.engineer import engineer_posts
from postmetrics.sources import archive as ar
from postmetrics.sources import sinks
from postmetrics.stats import linalg as la
from postmetrics.stats.design import build_design, design_frame
from postmetrics.stats.linalg import sym_pinv
from postmetrics.stats.models import fit_entity_fe, fit_ols, fit_poisson


def _frame(spark, n=600, seed=1):
    rnd = np.random.default_rng(seed)
    cat = rnd.choice(["a", "b", "c"], n)
    tier = np.where(cat == "a", "t0", rnd.choice(["t1", "t2"], n))     # nested-ish levels
    flag = rnd.random(n) < 0.3
    x = rnd.normal(size=n)
    const = np.ones(n)                                                   # duplicates the intercept
    y = 1.0 + 0.5 * (cat == "b") - 0.3 * flag + 0.8 * x + rnd.normal(scale=0.5, size=n)
    cnt = rnd.poisson(np.exp(0.2 + 0.4 * (cat == "c") + 0.3 * x))
    pdf = pd.DataFrame({"cat": cat, "tier": tier, "flag": flag, "x": x, "const": const, "y": y, "cnt": cnt.astype(float)})
    return spark.createDataFrame(pdf), pdf


def _dense(pdf):
    cols = [np.ones(len(pdf))]
    for lv in ["b", "c"]:
        cols.append((pdf.cat == lv).astype(float).to_numpy())
    for lv in ["t1", "t2"]:
        cols.append((pdf.tier == lv).astype(float).to_numpy())
    cols += [pdf.flag.astype(float).to_numpy(), pdf.x.to_numpy(), pdf.const.to_numpy()]
    return np.column_stack(cols)


TERMS = [("cat", "cat"), ("cat", "tier"), ("bool", "flag"), ("num", "x"), ("num", "const")]


def test_ols_hc1_rank_deficient_matches_numpy(spark):
    df, pdf = _frame(spark)
    fit = fit_ols(df, "y", TERMS)
    X, y = _dense(pdf), pdf.y.to_numpy()
    beta = np.linalg.pinv(X, rcond=1e-10) @ y
    assert fit.rank == np.linalg.matrix_rank(X)
    assert np.allclose(fit.params, beta, atol=1e-8)
    e = y - X @ beta
    bread = np.linalg.pinv(X.T @ X, rcond=1e-12, hermitian=True)
    n, k = X.shape[0], np.linalg.matrix_rank(X)
    cov = bread @ (X.T * e ** 2) @ X @ bread * n / (n - k)
    assert np.allclose(fit.cov, cov, atol=1e-8)
    assert fit.names[:3] == ["Intercept", "C(cat)[T.b]", "C(cat)[T.c]"]
    r2 = 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))
    assert math.isclose(fit.summary["r_squared"], r2, rel_tol=1e-10)


def test_poisson_matches_numpy_irls(spark):
    df, pdf = _frame(spark, seed=2)
    fit = fit_poisson(df, "cnt", [("cat", "cat"), ("num", "x")])
    X = np.column_stack([np.ones(len(pdf)), (pdf.cat == "b"), (pdf.cat == "c"), pdf.x]).astype(float)
    y = pdf.cnt.to_numpy()
    b = np.zeros(4)
    for _ in range(100):
        mu = np.exp(X @ b)
        z = X @ b + (y - mu) / mu
        nb = np.linalg.solve(X.T @ (mu[:, None] * X), X.T @ (mu * z))
        if np.max(abs(nb - b)) < 1e-13:
            b = nb
            break
        b = nb
    assert np.allclose(fit.params, b, atol=1e-9)
    mu = np.exp(X @ b)
    bread = np.linalg.inv(X.T @ (mu[:, None] * X))
    cov = bread @ (X.T * (y - mu) ** 2) @ X @ bread * len(y) / (len(y) - 4)
    assert np.allclose(fit.cov, cov, atol=1e-9)


def test_entity_fe_matches_within_estimator(spark):
    rnd = random.Random(4)
    rows = [(f"e{rnd.randrange(30)}", rnd.random(), rnd.random()) for _ in range(400)] + [("lonely", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "ent string, x double, y double")
    fit = fit_entity_fe(df, "y", ["x"], "ent")
    pdf = pd.DataFrame(rows, columns=["ent", "x", "y"])
    pdf = pdf[pdf.groupby("ent").ent.transform("count") >= 2]
    xt = pdf.x - pdf.groupby("ent").x.transform("mean")
    yt = pdf.y - pdf.groupby("ent").y.transform("mean")
    slope = (xt * yt).sum() / (xt * xt).sum()
    resid = yt - slope * xt
    dfree = len(pdf) - 2 - (pdf.ent.nunique() - 1)
    se = math.sqrt((resid ** 2).sum() / dfree / (xt * xt).sum())
    i = fit.names.index("x")
    assert math.isclose(fit.params[i], slope, rel_tol=1e-9)
    assert math.isclose(fit.bse[i], se, rel_tol=1e-9)
    assert fit.summary["entities"] == pdf.ent.nunique()


def test_distribution_functions():
    assert math.isclose(la.norm_sf2(1.959963984540054), 0.05, rel_tol=1e-12)
    assert math.isclose(la.t_sf2(2.0, 10), 0.0733880347707404, rel_tol=1e-9)
    assert math.isclose(la.f_sf(3.0, 4, 806), 0.0179078302, rel_tol=1e-7)  # numerical integration


def test_label_validation(spark):
    good = json.dumps({"humor_type": "observational", "topic_category": "tech", "has_data_reference": True,
                       "shows_vulnerability": False, "critique_type": "none"})
    missing = json.dumps({"humor_type": "observational", "topic_category": "tech"})
    rows = [(1, good), (2, missing), (3, "not json"), (4, None)]
    df = spark.createDataFrame(rows, "id long, reply string")
    got = {r.id: r for r in df.select("id", *lb.validate(F.col("reply"))).collect()}
    assert got[1].humor_type == "observational" and got[1].has_data_reference is True
    for i in (2, 3, 4):
        assert got[i].asDict() == {"id": i, **lb.NEUTRAL}


def test_failing_labeler_gives_neutral(spark):
    def broken(texts):
        raise RuntimeError("service down")
    df = spark.createDataFrame([(1, "hello there"), (2, "another one")], "id long, text string")
    got = lb.label_posts(df, "id", "text", broken).collect()
    assert all({k: r[k] for k in lb.LABEL_FIELDS} == lb.NEUTRAL for r in got)


def _post(i):
    return {"id_str": str(i), "created_at": "Wed Oct 10 20:19:24 +0000 2018", "full_text": f"post {i}",
            "favorite_count": "3", "user": {"id_str": "9", "screen_name": "someone"}}


@pytest.mark.parametrize("shape", ["jsonl_wrapped", "jsonl_bare", "array_wrapped", "array_bare",
                                   "object_one_line", "object_pretty", "single_record"])
def test_archive_shapes(spark, tmp_path, shape):
    posts = [_post(i) for i in range(3)]
    p = tmp_path / "archive.json"
    if shape == "jsonl_wrapped":
        p.write_text("\n".join(json.dumps({"tweet": x}) for x in posts))
    elif shape == "jsonl_bare":
        p.write_text("\n".join(json.dumps(x) for x in posts))
    elif shape == "array_wrapped":
        p.write_text(json.dumps([{"tweet": x} for x in posts], indent=2))
    elif shape == "array_bare":
        p.write_text(json.dumps(posts))
    elif shape == "object_one_line":
        p.write_text(json.dumps({"tweets": [{"tweet": x} for x in posts], "following": []}))
    elif shape == "object_pretty":
        p.write_text(json.dumps({"tweets": posts}, indent=2))
    else:
        p.write_text(json.dumps(posts[0], indent=2))
        posts = posts[:1]
    got = sorted(r.id_str for r in ar.load_posts(spark, str(p)).collect())
    assert got == sorted(x["id_str"] for x in posts)


def test_archive_scalar_raises_and_empty(spark, tmp_path):
    p = tmp_path / "scalar.json"
    p.write_text("42")
    with pytest.raises(ValueError):
        ar.load_posts(spark, str(p))
    e = tmp_path / "empty.json"
    e.write_text("")
    assert ar.load_posts(spark, str(e)).count() == 0


def test_resume_writes_only_missing_batches(spark, tmp_path):
    wanted = spark.createDataFrame([(i, i // 10) for i in range(50)], "id long, batch int")
    path = str(tmp_path / "out")
    wanted.where("batch < 2 OR (batch = 2 AND id < 24)").write.parquet(path)
    produced = []

    def produce(todo):
        produced.append(sorted(r.id for r in todo.collect()))
        return todo

    final, failed = sinks.resume_batches(spark, wanted, "batch", path, produce, ["id"])
    assert produced == [list(range(24, 50))] and not failed
    assert sorted(r.id for r in final.collect()) == list(range(50))


def test_resume_goes_on_after_a_failing_group(spark, tmp_path):
    wanted = spark.createDataFrame([(i, i // 10) for i in range(50)], "id long, batch int")
    path = str(tmp_path / "out")

    def produce(todo):
        if todo.where("batch = 3").count():
            raise OSError("service down")
        return todo

    final, failed = sinks.resume_batches(spark, wanted, "batch", path, produce, ["id"], groups=5)
    missing = set(range(50)) - {r.id for r in final.collect()}
    assert [e for _, e in failed] == ["service down"] and set(range(30, 40)) <= missing < set(range(50))
    again, failed = sinks.resume_batches(spark, wanted, "batch", path, lambda t: t, ["id"], groups=5)
    assert not failed and sorted(r.id for r in again.collect()) == list(range(50))


def test_a_killed_append_is_never_half_visible(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    rows = spark.range(100).select(F.col("id"), (F.col("id") % 4).cast("int").alias("batch")).repartition(4)
    sinks.resume_batches(spark, rows.where("batch < 1"), "batch", path, lambda t: t, ["id"])
    commit = sinks._commit

    def killed(*a, **k):
        raise KeyboardInterrupt("killed between write and publish")
    monkeypatch.setattr(sinks, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        sinks.resume_batches(spark, rows, "batch", path, lambda t: t, ["id"])
    assert len(list((tmp_path / "out" / "data").iterdir())) == 2  # written, but
    assert sinks.published(spark, path).count() == 25             # not visible
    monkeypatch.setattr(sinks, "_commit", commit)
    final, failed = sinks.resume_batches(spark, rows, "batch", path, lambda t: t, ["id"])
    assert sorted(r.id for r in final.collect()) == list(range(100)) and not failed


def test_resume_raises_programming_errors_and_total_failure(spark, tmp_path):
    rows = spark.range(10).select(F.col("id"), F.lit(0).alias("batch"))
    with pytest.raises(NameError):
        sinks.resume_batches(spark, rows, "batch", str(tmp_path / "a"), lambda t: undefined_name, ["id"], groups=2)  # noqa: F821

    def down(todo):
        raise OSError("service down")
    with pytest.raises(OSError):
        sinks.resume_batches(spark, rows, "batch", str(tmp_path / "b"), down, ["id"], groups=2)


def test_ledger_records_failures_and_resumes(spark, tmp_path):
    from postmetrics.sources import ledger
    wanted = spark.createDataFrame([(str(i), i // 3) for i in range(10)], "id string, batch int")
    path, schema = str(tmp_path / "accounts"), "id string, n bigint"

    def flaky(ids):
        if "4" in ids:
            raise TimeoutError("no answer")
        return [{"id": i, "n": int(i) * 2} for i in ids]
    assert ledger.progress(spark, path, wanted).first()[:] == (4, 0, 0, 4)
    got = ledger.fetch_batches(spark, wanted, flaky, path, schema)
    assert sorted(int(r.id) for r in got.collect()) == [0, 1, 2, 6, 7, 8, 9]
    assert ledger.progress(spark, path, wanted).first()[:] == (4, 3, 1, 0)
    state = {r.batch: (r.attempts, r.state, r.error, r.records) for r in ledger.ledger(spark, path).collect()}
    assert state[1] == (1, "failed", "TimeoutError: no answer", 0) and state[0] == (1, "done", None, 3)
    again = ledger.fetch_batches(spark, wanted, lambda ids: [{"id": i, "n": -1} for i in ids], path, schema)
    assert {int(r.id): r.n for r in again.collect()} == {**{i: 2 * i for i in range(10)}, 3: -1, 4: -1, 5: -1}
    assert {r.batch: r.attempts for r in ledger.ledger(spark, path).collect()} == {0: 1, 1: 2, 2: 1, 3: 1}


def test_accounts_have_their_own_owner_cap_and_tiers(spark):
    from pyspark.errors import PySparkException
    from postmetrics.operators import accounts as ac
    from postmetrics.operators.joins import infer_owner
    rows = [("a", "1", "Anna", "9", 1.0), ("a", "1", "Anna", "1", 3.0), ("a", "2", "Bob", None, 5.0),
            ("b", None, None, "7", 10.0), ("b", None, None, "7", 20.0), ("b", None, None, "8", 30.0), ("c", None, None, None, 2.0)]
    df = spark.createDataFrame(rows, "acct string, author string, screen string, target string, v double")
    hints = spark.createDataFrame([("a", "bob"), ("b", "nobody")], "account string, screen_name string")
    own = ac.owners(df, "acct", "author", "screen", "target", hints)
    assert {r.account: r.owner_id for r in own.collect()} == {"a": "2", "b": "7", "c": None}
    assert {r.account: r.owner_id for r in ac.owners(df, "acct", "author", "screen", "target").collect()}["a"] == "1"
    dim = ac.account_dimension(df, "acct", "v", own, cap_q=0.5)
    assert {r.account: r.cap for r in dim.collect()} == {"a": 3.0, "b": 20.0, "c": 2.0}
    with pytest.raises(PySparkException):
        ac.account_dimension(df, "acct", "v", own, required=True).collect()
    nobody = df.where("acct = 'c'")
    assert infer_owner(nobody, "author", "screen", "target").first()[0] is None
    with pytest.raises(PySparkException):
        infer_owner(nobody, "author", "screen", "target", required=True).collect()


def test_mutual_pairs_by_account(spark):
    from postmetrics.operators import network as nw
    following = spark.createDataFrame([(0, i) for i in range(50)] * 2 + [(1, 3), (1, None), (None, 3)], "account_id long, other_id long")
    followers = spark.createDataFrame([(0, i) for i in range(40, 60)] + [(1, 4), (2, 3)], "account_id long, other_id long")
    assert sorted(tuple(r) for r in nw.mutuals_by_account(following, followers).collect()) == [(0, i) for i in range(40, 50)]
    got = {r.account_id: (r.total_following, r.total_followers, r.total_mutual) for r in nw.network_summary_by_account(following, followers).collect()}
    assert got == {0: (50, 20, 10), 1: (1, 1, 0), 2: (0, 1, 0)}


def test_wide_factor_equals_the_dense_fit(spark):
    from postmetrics.stats import models as M
    rng = np.random.default_rng(12)
    f, z = rng.integers(0, 40, 3000), rng.normal(size=3000)
    flag = rng.random(3000) < 0.4
    y = f * 0.3 + 2 * z - flag + rng.normal(size=3000) * (1 + (f % 3))
    df = spark.createDataFrame(pd.DataFrame({"f": f, "z": z, "flag": flag, "y": y}))
    terms = [("cat", "f"), ("num", "z"), ("bool", "flag")]
    dense, wide = fit_ols(df, "y", terms), M.fit_wide_factor(df, "y", "f", terms[1:])
    assert wide.names == dense.names and wide.rank == dense.rank
    assert np.allclose(wide.params, dense.params, atol=1e-9) and np.allclose(wide.bse, dense.bse, atol=1e-9)
    assert math.isclose(wide.summary["r_squared"], dense.summary["r_squared"], rel_tol=1e-9)
    alone, dense = M.fit_wide_factor(df, "y", "f"), fit_ols(df, "y", terms[:1])
    assert np.allclose(alone.params, dense.params, atol=1e-9) and np.allclose(alone.bse, dense.bse, atol=1e-9)
    # wider than the matrix takes: the same entry point
    wide_rows = spark.range(6000).select((F.col("id") % 1500).alias("f"), F.col("id").cast("double").alias("y"))
    assert len(fit_ols(wide_rows, "y", [("cat", "f")]).names) == 1500


def test_wide_factor_of_more_than_a_million_levels(spark):
    """Levels are rows of a table, however many: level l has y = l % 7 - 1 and l % 7 + 1."""
    from postmetrics.stats import models as M
    k = 1_000_200
    rows = spark.range(2 * k).select((F.col("id") % k).alias("f"), ((F.col("id") % k) % 7 + F.when(F.col("id") < k, -1.0).otherwise(1.0)).alias("y"))
    fit = M.fit_wide_factor(rows, "y", "f")
    assert fit.rank == k and fit.n == 2 * k
    table = fit.table(spark)
    found = table.agg(F.count("*").alias("n"), F.countDistinct("term").alias("terms"), F.sum(F.abs("coef")).alias("s"), F.min("se").alias("lo"),
                      F.max("se").alias("hi"), F.count("p").alias("p")).first()
    assert (found.n, found.terms, found.p) == (k, k, k)
    assert math.isclose(found.s, sum(i % 7 for i in range(1, k)), rel_tol=1e-9)
    # HC1: sum of e^2 over n^2 is 1/2 for a level, twice that against the base, times n / (n - k)
    assert math.isclose(found.lo, 1.0, rel_tol=1e-9) and math.isclose(found.hi, math.sqrt(2.0), rel_tol=1e-9)


def test_wide_factor_table_is_that_of_the_dense_fit(spark):
    from postmetrics.stats import models as M
    rng = np.random.default_rng(21)
    f, z = rng.choice(["b", "a", "d", "c"], 800), rng.normal(size=800)
    flag = rng.random(800) < 0.4
    y = (f == "c") * 1.5 + 0.7 * z - 0.2 * flag + rng.normal(size=800) * (1 + (f == "b"))
    df = spark.createDataFrame(pd.DataFrame({"f": f, "z": z, "flag": flag, "y": y}))
    for other in ([("num", "z")], [("num", "z"), ("bool", "flag")]):
        for exp in (False, True):
            want = {r.term: r for r in fit_ols(df, "y", [("cat", "f"), *other]).table(spark, exp).collect()}
            got = {r.term: r for r in M.fit_wide_factor(df, "y", "f", other).table(spark, exp).collect()}
            assert set(got) == set(want)
            for term, r in got.items():
                assert np.allclose(list(r)[1:], list(want[term])[1:], rtol=1e-7, atol=1e-9), term


def test_cells_and_rows_give_the_same_fits(spark, monkeypatch):
    from postmetrics.stats import gram as G
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"a": rng.choice(list("xyz"), 2000), "b": rng.random(2000) < 0.3,
                                             "y": rng.poisson(3.0, 2000).astype(float)}))
    terms = [("cat", "a"), ("bool", "b"), ("inter", ("cat", "a"), ("bool", "b"))]
    fits = [(fit_ols(df, "y", terms), fit_poisson(df, "y", terms))]
    monkeypatch.setattr(G, "MAX_CELLS", 0)
    fits.append((fit_ols(df, "y", terms), fit_poisson(df, "y", terms)))
    for one, two in zip(*fits):
        assert np.allclose(one.params, two.params, atol=1e-8) and np.allclose(one.cov, two.cov, atol=1e-8)
        for k in ("llf", "skew", "kurtosis", "deviance", "pearson_chi2", "pseudo_r2_cs"):
            if k in one.summary:
                assert math.isclose(one.summary[k], two.summary[k], rel_tol=1e-8, abs_tol=1e-8), k


def test_csv_roundtrip_keeps_texts(spark, tmp_path):
    texts = ['line one\nline "two"', "  padded  ", "comma, inside"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    path = sinks.write_csv(df, str(tmp_path / "csv"))
    back = ar.read_labelled_csv(spark, path, "id long, text string")
    assert sorted((r.id, r.text) for r in back.collect()) == list(enumerate(texts))


def test_engineer_posts_end_to_end(spark, tmp_path):
    from postmetrics.operators.engineer import core_sample, engineer_posts

    def post(i, **kw):
        base = {"id_str": str(i), "created_at": f"Mon Jan 0{1 + i % 5} 10:00:0{i % 10} +0000 2024",
                "full_text": f"post number {i}", "favorite_count": str(i), "retweet_count": "1",
                "user": {"id_str": "7", "screen_name": "Owner"}}
        base.update(kw)
        return {"tweet": base}

    rows = [post(0), post(1, in_reply_to_status_id_str="0", in_reply_to_user_id_str="7"),
            post(2, in_reply_to_status_id_str="1", in_reply_to_user_id_str="8", full_text="see https://t.co/x ?"),
            post(3, retweeted=True), post(4, is_quote_status=True),
            post(5, entities={"hashtags": [{"text": "a"}, {"text": "b"}]},
                 extended_entities={"media": [{"id_str": "m"}]}),
            post(6, in_reply_to_status_id_str="999", in_reply_to_user_id_str="9")]
    p = tmp_path / "archive.jsonl"
    p.write_text("\n".join(json.dumps(r) for r in rows))
    from postmetrics.sources import archive
    eng = {r.id_str: r for r in engineer_posts(archive.load_posts(spark, str(p))).collect()}
    assert eng["1"].reply_type == "reply_own" and eng["2"].reply_type == "reply_other"
    assert eng["0"].reply_type == "none"
    assert eng["2"].has_link and eng["2"].has_question_mark
    assert eng["3"].is_retweet and eng["4"].is_quote_tweet
    assert eng["5"].num_hashtags == 2 and eng["5"].has_media
    assert eng["2"].thread_id == "0" and eng["2"].thread_step_index == 2
    assert eng["6"].thread_id == "999" and eng["6"].is_thread_starter
    assert eng["1"].total_engagement == 2 and eng["1"].weekday == "Tuesday"
    core = {r.id_str for r in core_sample(engineer_posts(archive.load_posts(spark, str(p)))).collect()}
    assert core == {"0", "2", "5", "6"}


def test_sums_do_not_depend_on_partitions(spark, monkeypatch):
    """One packed row per partition, summed in slots: the same fit for any number of either."""
    from postmetrics.stats import gram as G
    df, _ = _frame(spark, seed=3)
    one = fit_ols(df.coalesce(1), "y", TERMS)
    monkeypatch.setattr(G, "SLOTS", 3)
    many = fit_ols(df.repartition(17), "y", TERMS)
    assert np.allclose(one.params, many.params, atol=1e-9)
    assert np.allclose(one.cov, many.cov, atol=1e-9)
    assert math.isclose(one.summary["kurtosis"], many.summary["kurtosis"], rel_tol=1e-9)
    frame = design_frame(df.repartition(5), build_design(df, TERMS), ["y"])
    partials = frame.mapInArrow(lambda it: (G._emit(np.ones(2)) for _ in [list(it)]), G._PACKED)
    assert partials.count() == 5


def test_prompt_labeler_adapter(spark):
    seen = []

    def fake_client(prompts):
        seen.extend(prompts)
        return [json.dumps({"humor_type": "observational", "topic_category": "tech", "has_data_reference": False,
                            "shows_vulnerability": False, "critique_type": "none"}) if "code" in p else "oops"
                for p in prompts]

    df = spark.createDataFrame([(1, "writing code"), (2, "a walk")], "id long, text string").coalesce(1)
    got = {r.id: r.topic_category for r in lb.label_posts(df, "id", "text", lb.PromptLabeler(fake_client, "Classify.")).collect()}
    assert got == {1: "tech", 2: "general"}


def test_poisson_separated_level_flagged(spark):
    rnd = np.random.default_rng(5)
    cat = rnd.choice(["a", "b", "z"], 900)
    y = np.where(cat == "z", 0, rnd.poisson(np.where(cat == "b", 3.0, 1.5)))
    df = spark.createDataFrame(pd.DataFrame({"cat": cat, "y": y.astype(float)}))
    fit = fit_poisson(df, "y", [("cat", "cat")])
    assert fit.summary["separated"] == ["C(cat)[T.z]"]
    i = fit.names.index("C(cat)[T.z]")
    assert math.isnan(fit.params[i])
    ma, mb = y[cat == "a"].mean(), y[cat == "b"].mean()
    assert math.isclose(fit.params[0], math.log(ma), rel_tol=1e-9)
    assert math.isclose(fit.params[fit.names.index("C(cat)[T.b]")], math.log(mb / ma), rel_tol=1e-9)
    t = {r.term: r for r in fit.table(spark).collect()}
    assert t["C(cat)[T.z]"].coef is None and t["C(cat)[T.b]"].se is not None


def test_ols_robust_f(spark):
    df, pdf = _frame(spark, seed=6)
    fit = fit_ols(df, "y", [("cat", "cat"), ("num", "x")])
    X = np.column_stack([np.ones(len(pdf)), pdf.cat == "b", pdf.cat == "c", pdf.x]).astype(float)
    y = pdf.y.to_numpy()
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ b
    bread = np.linalg.inv(X.T @ X)
    V = bread @ (X.T * e ** 2) @ X @ bread * len(y) / (len(y) - 4)
    f = b[1:] @ np.linalg.inv(V[1:, 1:]) @ b[1:] / 3
    assert math.isclose(fit.summary["f_stat"], f, rel_tol=1e-8)
    assert fit.summary["f_df"] == (3, len(y) - 4)
    assert 0.0 <= fit.summary["f_pvalue"] <= 1.0


def test_entity_fe_summary_statistics(spark):
    rnd = np.random.default_rng(8)
    ent = rnd.integers(0, 20, 500)
    x = rnd.normal(size=500) + ent * 0.1
    y = 2.0 * x + ent * 0.5 + rnd.normal(size=500)
    pdf = pd.DataFrame({"ent": ent.astype(str), "x": x, "y": y})
    fit = fit_entity_fe(spark.createDataFrame(pdf), "y", ["x"], "ent")
    s = fit.summary
    fitted = fit.params[fit.names.index("const")] + fit.params[fit.names.index("x")] * x

    def explained(y, p):
        return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert math.isclose(s["r_squared_overall"], explained(y, fitted), rel_tol=1e-9)
    g = pdf.assign(p=fitted).groupby("ent")[["y", "p"]].mean()
    assert math.isclose(s["r_squared_between"], explained(g.y, g.p), rel_tol=1e-9)
    row = {r.term: r for r in fit.table(spark).collect()}["x"]
    assert row.ci_upper - row.coef > 1.96 * row.se and 0 <= row.p <= 1  # Student's t, wider than normal
    assert s["poolability_df"] == (19, 500 - 2 - 19) and s["poolability_f"] > 1


def _panel(spark):
    """30 entities with incomplete rows; two with one row, one of them incomplete, and rows without entity."""
    rnd = np.random.default_rng(31)
    ent = rnd.integers(0, 30, 700)
    x, z = rnd.normal(size=700) + ent * 0.1, rnd.normal(size=700) ** 2
    y = 2.0 * x - z + ent * 0.5 + rnd.normal(size=700) ** 3
    rows = [[f"e{e}", f"t{i % 9}", *map(float, v)] for i, (e, *v) in enumerate(zip(ent, x, z, y))]
    for i in range(0, 700, 23):
        rows[i][2 + i % 3] = None if i % 2 else float("nan")
    rows += [["one", "only", 1.0, 2.0, 3.0], ["none", "t1", None, 2.0, 3.0], [None, "t1", 1.0, 2.0, 3.0], ["half", "t2", 1.0, 2.0, 3.0], ["half", "t2", 1.0, 2.0, None]]
    df = spark.createDataFrame(rows, "ent string, t string, x double, z double, y double")
    pdf = pd.DataFrame(rows, columns=["ent", "t", "x", "z", "y"])
    return df, pdf[pdf.groupby("ent").ent.transform("count") >= 2].dropna()  # 'half' stays with its complete row


def test_entity_fe_sums_equal_those_of_the_rows(spark):
    df, pdf = _panel(spark)
    fit = fit_entity_fe(df, "y", ["x", "z"], "ent", time="t")
    s, n, n_ent = fit.summary, len(pdf), pdf.ent.nunique()
    g = pdf.groupby("ent")[["x", "z", "y"]]
    c = pdf[["x", "z", "y"]] - g.transform("mean")
    slopes = np.linalg.lstsq(c[["x", "z"]], c.y, rcond=None)[0]
    e = (c.y - c[["x", "z"]] @ slopes).to_numpy()
    const = pdf.y.mean() - pdf[["x", "z"]].mean().to_numpy() @ slopes
    assert np.allclose(fit.params, [const, *slopes], rtol=1e-9) and fit.n == n and fit.rank == 3
    p = const + pdf[["x", "z"]] @ slopes
    means = g.mean().assign(p=lambda m: const + m[["x", "z"]] @ slopes)
    dense = np.column_stack([np.ones(n), pdf[["x", "z"]]])
    pooled = ((pdf.y - dense @ np.linalg.lstsq(dense, pdf.y, rcond=None)[0]) ** 2).sum()
    want = dict(ssr=(e ** 2).sum(), llf=-n / 2 * (math.log(2 * math.pi) + math.log((e ** 2).mean()) + 1), skew=(e ** 3).mean() / (e ** 2).mean() ** 1.5,
                kurtosis=(e ** 4).mean() / (e ** 2).mean() ** 2, r_squared_within=1 - (e ** 2).sum() / (c.y ** 2).sum(),
                r_squared_overall=1 - ((pdf.y - p) ** 2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum(),
                r_squared_between=1 - ((means.y - means.p) ** 2).sum() / ((means.y - means.y.mean()) ** 2).sum(),
                poolability_f=(pooled - (e ** 2).sum()) / (n_ent - 1) / ((e ** 2).sum() / (n - 3 - (n_ent - 1))))
    for k, v in want.items():
        assert math.isclose(s[k], v, rel_tol=1e-8), k
    sizes, per = pdf.groupby("ent").size(), pdf.groupby("t").size()
    assert s["entities"] == n_ent == 31 and s["obs_per_entity"] == (1, sizes.max(), sizes.mean())
    assert s["time_periods"] == 9 and s["obs_per_period"] == (per.min(), per.max(), per.mean())


@pytest.mark.parametrize("full", [False, True])
def test_entity_fe_joins_no_rows(spark, monkeypatch, full):
    """Sums of entities are enough: no join (nor its sort of all rows in a task) and no Python over rows."""
    df, pdf = _panel(spark)
    df = df.where("ent LIKE 'e%'")

    def refuse(*args, **kwargs):
        raise AssertionError("rows are moved")
    for name in ("join", "mapInArrow", "mapInPandas", "toPandas", "toArrow"):
        monkeypatch.setattr(type(df), name, refuse)
    fit = fit_entity_fe(df, "y", ["x", "z"], "ent", full_summary=full, time="t")
    assert fit.n == len(pdf) - 1 and fit.summary["entities"] == 30


@pytest.mark.parametrize("unit", [1.0, 1e6, 1e-3])
def test_ols_with_regressors_of_different_size(spark, unit):
    """Estimates equal least squares when a large or tiny regressor stands next to a rare dummy."""
    rnd = np.random.default_rng(3)
    n = 4000
    x = rnd.uniform(0, unit, n)
    rare = np.arange(n) < 10
    nested = np.arange(n) < 1000
    y = 1.0 + 2.0 * x / unit + 0.7 * rare - 0.3 * nested + rnd.normal(size=n) * 0.1
    df = spark.createDataFrame(pd.DataFrame({"x": x, "rare": rare, "nested": nested, "y": y}))
    fit = fit_ols(df, "y", [("num", "x"), ("bool", "rare"), ("bool", "nested")])
    want = np.linalg.lstsq(np.column_stack([np.ones(n), x, rare, nested]).astype(float), y, rcond=None)[0]
    assert fit.rank == 4
    assert np.allclose(fit.params, want, rtol=1e-8, atol=0)


def test_sym_pinv_is_the_moore_penrose_inverse():
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(200, 5)) * np.array([1, 1e5, 1e-3, 1, 1])
    x[:, 4] = 3 * x[:, 0] - 2 * x[:, 3]
    inv, rank = sym_pinv(x.T @ x)
    y = rnd.normal(size=200)
    assert rank == 4
    scaled = np.linalg.pinv(x, rcond=1e-13) @ y
    assert np.allclose(inv @ (x.T @ y), scaled, rtol=1e-6)
    inv, rank = sym_pinv(np.diag([4.0, 0.0]))
    assert rank == 1 and np.allclose(inv, np.diag([0.25, 0.0]))


def test_log_gamma_series():
    from postmetrics.stats.gram import _lgamma1p
    y = np.array([0.0, 0.5, 1, 2, 7, 100, 1e6, 3e9])
    assert np.allclose(_lgamma1p(y), [math.lgamma(v + 1) for v in y], rtol=1e-13, atol=1e-12)


def test_one_failing_text_is_one_neutral_row(spark):
    from postmetrics.operators.labels import label_replies

    def labeler(texts):
        if (texts == "bad").any():
            raise ValueError("refused")
        return texts.map(lambda t: "ok")
    df = spark.createDataFrame([(i, "bad" if i == 37 else f"t{i}") for i in range(200)], "id long, text string").coalesce(1)
    got = {r.id: r.reply for r in label_replies(df, "id", "text", {"m": labeler}).collect()}
    assert [i for i, r in got.items() if r is None] == [37] and len(got) == 200


def test_bad_json_line_fails_or_is_left_out(spark, tmp_path):
    path = tmp_path / "posts.json"
    path.write_text('{"id_str": "1"}\n{"id_str": \n{"tweets": [{"tweet": {"id_str": "2"}}, {"id_str": "3"}]}\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        ar.load_posts(spark, str(path)).collect()
    assert sorted(r.id_str for r in ar.load_posts(spark, str(path), skip_bad=True).collect()) == ["1", "2", "3"]


def test_dotted_columns_and_last_parent(spark):
    rows = [("1", "2024-01-01 00:00:00", None, ["m"], ["h", "g"]), ("2", "2024-01-02 00:00:00", "9", None, []),
            ("2", "2024-01-03 00:00:00", "1", None, None)]
    df = spark.createDataFrame(rows, "id_str string, created_at string, in_reply_to_status_id_str string, "
                                     "`tweet.extended_entities.media` array<string>, `tweet.entities.hashtags` array<string>").coalesce(1)
    got = engineer_posts(df, owner_id="7").collect()
    assert {(r.id_str, r.has_media, r.num_hashtags) for r in got} == {("1", True, 2), ("2", False, 0)}
    assert {r.thread_id for r in got if r.id_str == "2"} == {"1"}


def test_poisson_likelihoods(spark):
    df, pdf = _frame(spark, seed=2)
    fit = fit_poisson(df, "cnt", [("cat", "cat"), ("num", "x")])
    y = pdf.cnt.to_numpy()
    lg = np.array([math.lgamma(v + 1) for v in y])
    X = np.column_stack([np.ones(len(pdf)), (pdf.cat == "b"), (pdf.cat == "c"), pdf.x]).astype(float)
    eta = X @ fit.params
    llf = (y * eta - np.exp(eta) - lg).sum()
    llnull = (y * math.log(y.mean()) - y.mean() - lg).sum()
    assert math.isclose(fit.summary["llf"], llf, rel_tol=1e-9)
    assert math.isclose(fit.summary["llnull"], llnull, rel_tol=1e-9)
    assert math.isclose(fit.summary["pseudo_r2_cs"], 1 - math.exp(2 * (llnull - llf) / len(y)), rel_tol=1e-9)


def test_full_shape_models_match_numpy(spark):
    from postmetrics.plans.q_models import FULL_TERMS, _core
    core = _core(spark, "/root/testdata/sf0.001").cache()
    pdf = core.select(*[t[1] for t in FULL_TERMS], "winsorized_engagement", "total_engagement").toPandas()
    cols, names = [np.ones(len(pdf))], ["Intercept"]
    for kind, c in FULL_TERMS:
        if kind == "cat":
            for lv in sorted(pdf[c].dropna().unique())[1:]:
                cols.append((pdf[c] == lv).astype(float).to_numpy())
                names.append(f"C({c})[T.{lv}]")
        else:
            cols.append(pdf[c].astype(float).to_numpy())
            names.append(c)
    X = np.column_stack(cols)
    y = np.log1p(pdf.winsorized_engagement.to_numpy())
    fit = fit_ols(core, F.log1p("winsorized_engagement"), FULL_TERMS)
    assert fit.names == names
    assert np.allclose(fit.params, np.linalg.pinv(X, rcond=1e-10) @ y, atol=1e-7)
    pfit = fit_poisson(core, F.col("total_engagement").cast("double"), FULL_TERMS)
    cnt = pdf.total_engagement.to_numpy().astype(float)
    b = np.zeros(X.shape[1])
    b[0] = math.log(cnt.mean())
    for _ in range(100):
        mu = np.exp(X @ b)
        nb = np.linalg.pinv(X.T @ (mu[:, None] * X), rcond=1e-12, hermitian=True) @ (X.T @ (mu * (X @ b + (cnt - mu) / mu)))
        done = np.max(abs(nb - b)) < 1e-12 * max(1, np.max(abs(nb)))
        b = nb
        if done:
            break
    assert np.allclose(pfit.params, b, atol=1e-6)
    core.unpersist()


def test_account_lookup_duplicates_and_missing(spark, tmp_path):
    batch = {"data": [{"id": "1", "username": "a", "most_recent_tweet_id": "10", "public_metrics": {"followers_count": 5}},
                      {"id": "2", "username": "b", "most_recent_tweet_id": "99"}],
             "includes": {"tweets": [{"id": "10", "created_at": "2024-01-01T00:00:00Z"},
                                     {"id": "10", "created_at": "2024-02-01T00:00:00Z"}]}}
    (tmp_path / "b1.json").write_text(json.dumps(batch, indent=2))
    users, tweets = ar.load_account_batches(spark, str(tmp_path / "b*.json"))
    got = {r.id: r for r in ar.flatten_users(users, tweets).collect()}
    assert len(got) == 2
    assert got["1"].most_recent_tweet_date == "2024-02-01T00:00:00Z" and got["1"].followers_count == 5
    assert got["2"].most_recent_tweet_date is None and got["2"].followers_count is None


def test_metadata_placeholder_and_empty_glob(spark, tmp_path):
    got = ar.read_kv_first_line(spark, str(tmp_path / "missing.txt"), "placeholder").collect()
    assert [r.value for r in got] == ["placeholder"]
    (tmp_path / "sel.txt").write_text("Selected Model: kw_swap\nAgreement: 97.1%\n")
    assert ar.read_kv_first_line(spark, str(tmp_path / "sel.txt")).first().value == "kw_swap"
    from pyspark.errors import AnalysisException
    with pytest.raises(AnalysisException):
        ar.load_account_batches(spark, str(tmp_path / "nothing_here*.json"))[0].collect()


def test_core_sweep_matches_numpy(spark):
    import __spark_entry__ as E
    from postmetrics.plans.derived import core_sample, engineered
    from postmetrics.plans.q_models import SWEEP_REPORT, SWEEP_TERMS, THRESHOLDS
    pdf = core_sample(engineered(spark, "/root/testdata/sf0.001", entities=True)).toPandas()
    cols, names = [np.ones(len(pdf))], ["Intercept"]
    for kind, c in SWEEP_TERMS:
        levels = {"cat": sorted(pdf[c].dropna().unique())[1:], "bool": [True], "num": [None]}[kind]
        for lv in levels:
            cols.append(pdf[c].astype(float).to_numpy() if kind == "num" else (pdf[c] == lv).astype(float).to_numpy())
            names.append({"cat": f"C({c})[T.{lv}]", "bool": f"{c}[T.True]", "num": c}[kind])
    X = np.column_stack(cols)
    assert all(0 < X[:, names.index(t)].sum() < len(X) for t in SWEEP_REPORT)
    want = {}
    for t in THRESHOLDS:
        y = np.log1p(pdf.total_engagement.clip(upper=pdf.total_engagement.quantile(t)).to_numpy())
        b = np.linalg.pinv(X, rcond=1e-10) @ y
        e = y - X @ b
        want |= {(round(t * 100), nm): b[names.index(nm)] for nm in SWEEP_REPORT}
        want[(round(t * 100), "R-squared")] = 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))
    rows = E.queries()["model_robust_sweep_core"](spark, "/root/testdata/sf0.001").collect()
    got = {(r["threshold"], r["term"]): r["value"] for r in rows}
    assert got.keys() == want.keys() and len(rows) == 12
    assert all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)


def test_sweep_on_any_design(spark):
    from postmetrics.stats.models import robust_sweep
    df, pdf = _frame(spark)
    got = {(t, nm): v for t, nm, v in robust_sweep(df, "cnt", TERMS, (0.5, 0.975), ("x", "C(cat)[T.zz]"))}
    for t in (0.5, 0.975):
        y = np.log1p(pdf.cnt.clip(upper=pdf.cnt.quantile(t)).to_numpy())
        X = _dense(pdf)
        b = np.linalg.pinv(X, rcond=1e-10) @ y
        assert math.isclose(got[(t, "x")], b[6], abs_tol=1e-8) and got[(t, "C(cat)[T.zz]")] == 0
        assert math.isclose(got[(t, "R-squared")], 1 - ((y - X @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs_tol=1e-8)


def test_ols_diagnostics_row(spark):
    import __spark_entry__ as E
    pdf = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", "value").toPandas().dropna()
    X = np.column_stack([np.ones(len(pdf)), *[(pdf.event_type == g).astype(float) for g in sorted(pdf.event_type.unique())[1:]]])
    y = pdf.value.to_numpy()
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    e, (n, k) = y - X @ b, X.shape
    bread = np.linalg.inv(X.T @ X)
    cov = bread @ (X.T * e ** 2) @ X @ bread * n / (n - k)
    row = E.queries()["model_ols_diagnostics"](spark, "/root/testdata/sf0.001").first()
    assert (row.nobs, row.f_df_num, row.f_df_den) == (n, k - 1, n - k)
    assert math.isclose(row.f_robust, b[1:] @ np.linalg.inv(cov[1:, 1:]) @ b[1:] / (k - 1), rel_tol=1e-5, abs_tol=2e-6)
    assert math.isclose(row.condition_number, np.linalg.cond(X), rel_tol=1e-6)
    z = (e - e.mean()) / e.std()
    assert math.isclose(row.omnibus, la.omnibus(n, (z ** 3).mean(), (z ** 4).mean()), rel_tol=1e-6)


def test_omnibus_of_published_fits():
    # the reference's printed summary (skew and kurtosis rounded there), and kurtosistest(range(20)) of scipy's manual
    assert math.isclose(la.omnibus(3386, 0.445, 2.453), 185.233, rel_tol=5e-3)
    z = (np.arange(20) - 9.5) / np.arange(20).std()
    assert math.isclose(la.omnibus(20, 0.0, (z ** 4).mean()), 1.7058104152122062 ** 2, rel_tol=1e-9)
    assert math.isnan(la.omnibus(7, 0.0, 3.0))


def test_json_metadata_with_defaults(spark, tmp_path):
    schema, defaults = "model_used string, total bigint", {"model_used": "placeholder"}

    def read(path):
        return [tuple(r) for r in ar.read_json_metadata(spark, str(path), schema, defaults).collect()]
    good, broken, part = tmp_path / "a.json", tmp_path / "b.json", tmp_path / "c.json"
    good.write_text(json.dumps({"model_used": "kw", "total": 7}, indent=2))
    broken.write_text("{not json")
    part.write_text('{"total": 3}')
    assert read(good) == [("kw", 7)] and read(part) == [("placeholder", 3)]
    assert read(broken) == read(tmp_path / "missing.json") == [("placeholder", None)]
