"""Toxicity: features, ratios, held-out accuracy and hard cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from postmetrics.llm import toxicity
from postmetrics.llm.q_toxicity import fold
from postmetrics.llm.registry import prepare


def test_n_grams_are_the_distinct_buckets_of_each_text():
    texts = ["Abc def", None, "", "abc  DEF abc\tdef", "é" * 5, "x" * 3]
    rows, buckets = toxicity.n_grams(texts)
    for k, t in enumerate(texts):
        padded = [32] + [ord(c.lower()) if c.isascii() else ord(c) for c in (t or "").replace("\t", " ")] + [32]
        expected = set()
        for n in toxicity.LENGTHS:
            for i in range(len(padded) - n + 1):
                h = sum(c * int(f) for c, f in zip(padded[i:i + n], toxicity._FACTORS)) % 2 ** 64
                expected.add(h >> (64 - toxicity.BITS))
        assert buckets[rows == k].tolist() == sorted(expected)


def test_slices_and_wanted_buckets_agree(monkeypatch):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab \n") for _ in range(rnd.randint(0, 60))) for _ in range(50)]
    whole = toxicity.n_grams(texts)
    monkeypatch.setattr(toxicity, "STEP_CHARS", 70)
    for a, b in zip(whole, toxicity.n_grams(texts)):
        assert np.array_equal(a, b)
    wanted = np.zeros(toxicity.BUCKETS, bool)
    wanted[np.unique(whole[1])[::3]] = True
    rows, buckets = toxicity.n_grams(texts, wanted)
    keep = wanted[whole[1]]
    assert np.array_equal(rows, whole[0][keep]) and np.array_equal(buckets, whole[1][keep])


def test_ratios_are_smoothed_and_weak_ones_left_out():
    toxic, clean = np.zeros(toxicity.BUCKETS), np.zeros(toxicity.BUCKETS)
    toxic[1], clean[2], toxic[3], clean[3] = 400, 400, 300, 300
    r = toxicity.log_count_ratios(toxic, clean)
    assert r[1] > 4 and r[2] < -4 and r[3] == 0 and not r[4:].any()
    p, q = toxic + 1.0, clean + 1.0
    assert np.isclose(r[1], np.log(p[1] / p.sum()) - np.log(q[1] / q.sum()))
    assert np.flatnonzero(toxicity.log_count_ratios(toxic, clean, most=1)).size == 1


def test_the_fit_lowers_the_weighted_loss():
    rng = np.random.default_rng(0)
    y = (np.arange(200) % 4 == 0).astype(int)
    rows, buckets = np.repeat(np.arange(200), 2), np.where(np.repeat(y, 2) == 1, 5, 6) + 10 * (rng.random(400) < 0.1)
    ratios = np.zeros(toxicity.BUCKETS)
    ratios[[5, 6, 15, 16]] = [2, -2, 2, -2]
    model = toxicity.fit(rows, buckets, y, np.ones(200), ratios)
    z = model.bias + np.bincount(rows, model.weights[buckets], minlength=200)
    loss = np.mean(np.logaddexp(0, np.where(y == 1, -z, z)))
    assert loss < 0.05 and ((z > 0) == (y == 1)).all()


def test_held_out_documents(spark):
    prepare(spark)
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, fold(F.col("id")) != 1)
    scored = toxicity.score(docs, model).where(fold(F.col("doc_id")) == 1).join(labels, "doc_id")
    counts = {(r.toxic, r.hit): r["count"] for r in scored.groupBy("toxic", (F.col("score") >= 0.7).alias("hit")).count().collect()}
    caught = counts[1, True] / (counts[1, True] + counts[1, False])
    wrong = counts.get((0, True), 0) / (counts.get((0, True), 0) + counts[0, False])
    assert caught > 0.75 and wrong < 0.01


def test_hard_rows(spark):
    prepare(spark)
    schema = "doc_id long, text string, label int, score double, id long, buckets string"
    rows = [(k, f"{'you idiot fool' if k % 3 == 0 else 'a fine day'} number {k}", 1, 0.5, 1, "x") for k in range(120)]
    rows += [(500, None, 1, 0.1, 2, ""), (501, "", 1, 0.1, 2, ""), (502, "long " * 300_000 + "idiot", 1, 0.2, 3, ""), (None, "idiot", 1, 0.3, 3, "")]
    rows += [rows[0], rows[0], (0, "other text under a used id", 1, 0.1, 1, "")]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    marks = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(0, 90)] + [(5, None), (6, 7), (None, 1)], "doc_id long, toxic int")
    first, again = (sorted(tuple(r) for r in toxicity.score(docs, toxicity.train(docs, marks)).fillna(-1, ["doc_id"]).collect()) for _ in range(2))
    assert first == again and len(first) == len(rows)
    score = {k: s for k, s in first}
    assert all(0 <= s <= 1 for s in score.values()) and score[500] == score[501]
    assert all((score[k] >= 0.7) == (k % 3 == 0) for k in range(91, 120))
    one_class = toxicity.train(docs, marks.where("toxic = 0"))
    assert one_class is None and {r.score for r in toxicity.score(docs, one_class).collect()} == {0.5}
    assert toxicity.train(docs.limit(0), marks) is None and toxicity.score(docs.limit(0), None).collect() == []
