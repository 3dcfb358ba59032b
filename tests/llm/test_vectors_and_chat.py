"""Vector and conversation operators: nulls, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmetrics.llm import chat, mtree, projections
from postmetrics.llm.components import connected_components
from postmetrics.llm.registry import prepare

SCHEMA = "vec_id long, embedding array<float>, id long, v string, score double, rank int"


def _vectors():
    rng = np.random.default_rng(3)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(16)
        for _ in range(12):
            rows.append((centre + rng.standard_normal(16) * rng.choice([0.02, 0.2, 0.35])).astype(np.float32).tolist())
    rows += [rng.standard_normal(16).astype(np.float32).tolist() for _ in range(80)]
    rows += [rows[0], rows[0], (2 * np.array(rows[0])).tolist(), rows[100]]
    out = [(7 * k % 400, r) for k, r in enumerate(rows)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0]]
    out += [(500 + k, r) for k, r in enumerate(bad)]
    return out + [(None, rows[3])]


@pytest.fixture(scope="module")
def vectors():
    return _vectors()


@pytest.fixture(scope="module")
def table(spark, vectors):
    prepare(spark)
    return spark.createDataFrame([(k, v, 1, "x", 0.1, 2) for k, v in vectors], SCHEMA).repartition(4)


def _good(v):
    return v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def _plain_links(vectors, least):
    use = [(k, np.array(v, np.float64)) for k, v in vectors if k is not None and _good(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in use])
    near = x @ x.T >= least
    label = np.array([k for k, _ in use])
    while True:
        new = np.where(near, label[None, :], 1 << 60).min(1)
        if np.array_equal(new, label):
            break
        label = new
    found = {k: (int(n) - 1, int(c)) for (k, _), n, c in zip(use, near.sum(1), label)}
    return Counter((k, *found.get(k, (0, k)), found.get(k, (0, k))[1] == k if k is not None else True) for k, _ in vectors)


@pytest.mark.parametrize("block", [1024, 8])
def test_projections_against_all_pairs(table, vectors, monkeypatch, block):
    monkeypatch.setattr(projections, "BLOCK", block)
    got = Counter(tuple(r) for r in projections.near_duplicates(table, 0.9).collect())
    assert got == _plain_links(vectors, 0.9)


def test_projections_recall_at_the_threshold(spark):
    """Pairs just above the threshold, in many cells: nearly all are found, none below it."""
    prepare(spark)
    rng = np.random.default_rng(9)
    rows = []
    for k in range(700):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        cos = 0.905 if k % 2 else 0.89
        rows += [(2 * k, a.tolist()), (2 * k + 1, (cos * a + np.sqrt(1 - cos * cos) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    links = {r["vec_id"]: r["n_links"] for r in projections.near_duplicates(df, 0.9).collect()}
    assert sum(links[2 * k] for k in range(1, 700, 2)) >= 0.98 * 350
    assert sum(links[2 * k] for k in range(0, 700, 2)) == 0


def test_mtree_against_all_scores(table, vectors, monkeypatch):
    for name, size in (("NODE_ROWS", 20), ("PAGE_ROWS", 4), ("QUERY_BLOCK", 7), ("NODE_BLOCK", 3)):
        monkeypatch.setattr(mtree, name, size)
    use = [(k, np.floor(256 * np.array(v, np.float64))) for k, v in vectors
           if k is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for q in sorted({k for k, _ in use if k % 5 == 0}):
        v = next(x for k, x in use if k == q)
        best = sorted((-int(v @ x), k) for k, x in use if k != q)[:5]
        want.update((q, n + 1, k, -s) for n, (s, k) in enumerate(best))
    got = mtree.top_k(table, F.col("id") % 5 == 0, 5, 256)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_mtree_fewer_candidates_than_k(spark):
    prepare(spark)
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.5, 0.5]), (7, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = mtree.top_k(df, F.col("id") % 50 == 0, 5, 256).collect()
    # equal scores: the smaller id first
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == {
        (0, 1, 50, 32768), (0, 2, 7, 0), (50, 1, 0, 32768), (50, 2, 7, 32768)}
    assert len(got) == 4


def test_components_of_a_long_chain(spark):
    prepare(spark)
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    links = [(a, b) for a, b in zip(ids, ids[1:])] + [(500, 501), (501, 502), (9, 9), (None, 4), (700, 700)]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["vertex"]: r["component"] for r in got} == {**{i: 0 for i in range(200)}, 500: 500, 501: 500, 502: 500}
    assert len(got) == 203


def test_empty_vectors(table):
    none = table.limit(0)
    assert projections.near_duplicates(none).count() == 0
    assert mtree.top_k(none, F.col("id") >= 0).count() == 0
    assert mtree.top_k(table, F.col("id") < 0).count() == 0


# -- chat ------------------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    prepare(spark)
    rng = random.Random(4)
    bits = ["</turn>\n", "<next/>\n", "<turn:user>\n", "&lt;", "&amp;", "&", "<", ">", "\\", "### Assistant:", " ok ", "é", "\n", ""]
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "assistant", "a>b<c&", None, ""])
            rows.append((conv, turn, role, rng.choice([None, "".join(rng.choices(bits, k=6))]), 1, "p"))
    rows += [(None, 0, "user", "x", 1, "p"), (50, None, "user", "b", 1, "p"), (50, None, "user", "a", 1, "p"), (50, 1, "user", "c", 1, "p"),
             (51, 0, "assistant", "same", 1, "p"), (51, 0, "assistant", "same", 1, "p")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start long, piece string").repartition(4)
    out = chat.format_conversations(df).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn(
        "loss", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()
    want = {}
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out} == want
    for r in out:
        own = want[r["conv_id"]]
        assert r["loss"] == "".join(t for role, t in own if role == "assistant")
        headers = sum(1 for i, (role, _) in enumerate(own) if i == 0 or own[i - 1][0] != role)
        assert r["formatted"].count("<turn:") == headers and r["formatted"].count("</turn>\n") == headers
        for s in r["loss_spans"]:
            assert "<" not in r["formatted"][s["start"]:s["start"] + s["length"]]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_plan_is_native(spark):
    prepare(spark)
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.format_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_digest_helpers_agree_with_hashlib(spark):
    df = spark.createDataFrame([("é",)], "t string").select(F.sha2("t", 256).alias("h"))
    assert df.first()["h"] == hashlib.sha256("é".encode()).hexdigest()


def test_roles_are_merged_without_a_window(spark):
    prepare(spark)
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.format_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "aggregate(" in plan and "Python" not in plan


@pytest.mark.parametrize("mean_cosine", [0.0, 0.7, 0.9])
def test_pairs_meet_whatever_the_mean_cosine(mean_cosine):
    """Pairs at cosine 0.905 share a cell and enough collisions, for 50,000 vectors that point one way."""
    rng, dim, n = np.random.default_rng(0), 64, 1500
    mu = projections._unit(rng.standard_normal((1, dim)))[0]

    def population(m):
        z = rng.standard_normal((m, dim))
        z = projections._unit(z - (z @ mu)[:, None] * mu)
        return math.sqrt(mean_cosine) * mu + math.sqrt(1 - mean_cosine) * z
    sample, x = population(4096), population(n)
    plan = projections.calibrate(0.9, 50_000, projections.sampled_spread(sample))
    turn = rng.standard_normal((n, dim))
    turn = projections._unit(turn - (turn * x).sum(1, keepdims=True) * x)
    y = 0.905 * x + math.sqrt(1 - 0.905 ** 2) * turn
    a = projections.directions(dim, plan.projections)
    medians = np.median(sample @ a, axis=0)
    (cx, nx), (cy, ny) = (projections._codes(v @ a, medians, plan) for v in (x, y))
    shared = (((cx ^ cy) & ~nx & ~ny) == 0).any(1)
    counted = (np.abs(x @ a - y @ a)[:, :plan.counted] <= plan.window).sum(1) >= plan.min_collisions
    assert (shared & counted).mean() >= 0.99
