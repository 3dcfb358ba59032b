"""Edge-case rows for the feature expressions (invented values)."""

import datetime as dt

from pyspark.sql import functions as F

from postmetrics.functions import features as fx
from postmetrics.operators.timeline import weekly_volume


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def test_parse_post_time(spark):
    df = one_col(spark, ["Wed Oct 10 20:19:24 +0000 2018", "2018-10-10T20:19:24Z", "garbage", None])
    got = [r[0] for r in df.select(fx.parse_post_time("x")).collect()]
    assert got[0] == dt.datetime(2018, 10, 10, 20, 19, 24)
    assert got[1] == dt.datetime(2018, 10, 10, 20, 19, 24)
    assert got[2] is None and got[3] is None


def test_tier_boundaries_inclusive_and_null_last(spark):
    a, b = "2023-09-12 00:00:00", "2024-09-12 00:00:00"
    ts = ["2023-09-11 23:59:59.999999", a, "2023-09-12 00:00:00.000001", "2024-09-11 23:59:59.999999", b,
          "2024-09-12 00:00:00.000001", None]
    df = spark.createDataFrame([(t,) for t in ts], "x string").select(F.col("x").cast("timestamp").alias("t"))
    got = [r[0] for r in df.select(fx.account_tier("t", fx.TIER_UPGRADED_START, fx.TIER_POST_UPGRADE_START)).collect()]
    assert got == [fx.TIER_PRE, fx.TIER_UPGRADED, fx.TIER_UPGRADED, fx.TIER_UPGRADED, fx.TIER_UPGRADED,
                   fx.TIER_POST, fx.TIER_POST]


def test_coerce_count(spark):
    got = [r[0] for r in one_col(spark, ["3", " 12 ", "x", None]).select(fx.coerce_count("x")).collect()]
    assert got == [3, 12, 0, 0]


def test_retweet_precedence(spark):
    rows = [(False, None, "RT @someone hi"), (None, None, "RT @someone hi"), (None, "1", "plain"), (None, None, None)]
    df = spark.createDataFrame(rows, "flag boolean, rs_id string, text string").withColumn(
        "rs", F.when(F.col("rs_id").isNotNull(), F.struct(F.col("rs_id").alias("id_str"))))
    got = [r[0] for r in df.select(fx.is_retweet("flag", "rs", "text")).collect()]
    assert got == [False, True, True, False]


def test_quote_rules(spark):
    url = "struct<expanded_url:string>"
    rows = [(True, None, None), (None, "9", None), (None, None, ["https://twitter.com/a/status/1"]),
            (None, None, ["https://twitter.com/a"]), (False, "9", None)]
    df = spark.createDataFrame(rows, "flag boolean, qid string, u array<string>").withColumn(
        "urls", F.transform("u", lambda x: F.struct(x.alias("expanded_url"))).cast(f"array<{url}>"))
    got = [r[0] for r in df.select(fx.is_quote("flag", "qid", "urls")).collect()]
    assert got == [True, True, True, False, False]


def test_reply_type(spark):
    rows = [("42", "42"), ("7", "42"), (None, "42"), ("42", ""), ("42", None)]
    df = spark.createDataFrame(rows, "target string, owner string")
    got = [r[0] for r in df.select(fx.reply_type("target", "owner")).collect()]
    assert got == [fx.REPLY_OWN, fx.REPLY_OTHER, fx.REPLY_NONE, fx.REPLY_OTHER, fx.REPLY_OTHER]


def test_text_length_and_min_length(spark):
    texts = [None, "\t\t    ", "a\U0001F600b", "x" * 15, "x" * 16, " " + "y" * 20 + "\t", "z" * 21]
    df = one_col(spark, texts)
    got = df.select(fx.text_length("x").alias("n"), fx.min_length("x", 15).alias("m15"),
                    fx.min_length("x", 20).alias("m20")).collect()
    assert [r.n for r in got] == [len(t or "") for t in texts]
    assert [r.m15 for r in got] == [False, False, False, False, True, True, True]
    assert [r.m20 for r in got] == [False, False, False, False, False, False, True]


def test_entity_counts(spark):
    rows = [(None,), ([],), (["a", "b"],)]
    df = spark.createDataFrame(rows, "tags array<string>")
    assert [r[0] for r in df.select(fx.entity_count("tags")).collect()] == [0, 0, 2]


def test_relative_week_floors(spark):
    base = dt.datetime(2024, 1, 15)
    days = [-1, -7, -8, 0, 6, 7]
    df = spark.createDataFrame([(base + dt.timedelta(days=d),) for d in days], "t timestamp")
    got = [r[0] for r in df.select(fx.relative_week("t", F.lit(base))).collect()]
    assert got == [-1, -1, -2, 0, 0, 1]


def test_week_period_label(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7, 23, 0),), (dt.datetime(2024, 1, 8, 1, 0),)], "t timestamp")
    assert [r[0] for r in df.select(fx.week_period("t")).collect()] == ["2024-01-01/2024-01-07", "2024-01-08/2024-01-14"]


def test_weekly_volume_fills_empty_weeks(spark):
    ts = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 22)]
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp")
    got = [(r.week_end, r.n_posts) for r in weekly_volume(df, "t").orderBy("week_end").collect()]
    assert got == [("2024-01-07", 2), ("2024-01-14", 0), ("2024-01-21", 0), ("2024-01-28", 1)]


def test_winsorize_null_cap_keeps_values(spark):
    df = spark.createDataFrame([(1.0, None), (5.0, 3.0)], "x double, cap double")
    assert [r[0] for r in df.select(fx.winsorize("x", "cap")).collect()] == [1.0, 3.0]


def test_null_and_odd_values(spark):
    from postmetrics.functions.numeric import round_half_even
    df = spark.createDataFrame([(1.0, "NaN"), (2.0, "1e30"), (None, "-Infinity"), (100.0, "12.9")], "x double, t string")
    got = df.select(fx.winsorize("x", F.lit(2.0)).alias("w"), fx.coerce_count("t").alias("c"),
                    fx.week_period(F.lit(None).cast("timestamp")).alias("p")).collect()
    assert [r.w for r in got] == [1.0, 2.0, None, 2.0]
    assert [r.c for r in got] == [0, 0, 0, 12]
    assert all(r.p is None for r in got)
    near = spark.createDataFrame([(3.25009, 1, 3.3), (3.25, 1, 3.2), (12.5009, 0, 13.0), (12.5, 0, 12.0), (-0.35, 1, -0.4)], "x double, d int, want double")
    for r in near.select("*", round_half_even("x", 1).alias("one"), round_half_even("x", 0).alias("none")).collect():
        assert (r.one if r.d == 1 else r.none) == r.want


def test_every_page_is_judged_by_its_whole_text(spark, tmp_path):
    import __spark_entry__ as E
    text = "x" * 200_000 + "\n<h1 id='a'> https://t.co/abc"
    rows = [(k, "u", text if k < 12 else "plain" if k < 24 else None) for k in range(25)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    for key, flag, more in (("proj_has_link_whole", "has_link", {"link added": 24, "no text": 0}),
                            ("proj_has_media_whole", "has_media", {"emptied": 0, "no media": 0})):
        got = E.queries()[key](spark, str(tmp_path)).collect()
        assert {r["page_id"] for r in got if r["input"] == "page" and r[flag]} == set(range(12))
        assert all(r[flag] is not None for r in got) and len(got) == 75
        assert {n: sum(r[flag] for r in got if r["input"] == n) for n in more} == more
