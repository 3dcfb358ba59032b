"""Hard negatives against all scores, and bounds that never hide a row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmetrics.llm import multi_index
from postmetrics.llm.registry import prepare

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, shelf long, rank int"


def _rows():
    rng = np.random.default_rng(11)
    out = []
    for c in range(8):
        centre = rng.standard_normal(12)
        for _ in range(40):
            out.append(((centre + rng.standard_normal(12) * rng.choice([0.1, 0.5, 1.0])) / 4).astype(np.float32).tolist())
    out += [out[0]] * 30 + [[0.0] * 12] * 3  # copies and ties
    rows = [(k, v, k % 5) for k, v in enumerate(out)]
    bad = [None, [], [float("nan")] + [1.0] * 11, [None] + [1.0] * 11, [float("inf")] * 12, [1.0, 2.0]]
    rows += [(1000 + 10 * k, v, 1) for k, v in enumerate(bad)] + [(2000, out[5], None), (None, out[6], 2)]
    return rows


def plain(rows, every, k=5, n=3):
    use = [(i, np.floor(256 * np.array(v, np.float64)), c) for i, v, c in rows
           if i is not None and c is not None and v is not None and len(v) == 12 and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q, c in use:
        if i % every:
            continue
        scored = sorted((-int(q @ x), j, d) for j, x, d in use if j != i)
        for s, j, _ in [t for t in scored if t[2] == c][:k]:
            p = -s
            fit = [(-t, m) for t, m, d in scored if d != c and 50 * p <= -100 * t <= 95 * p][:n]
            out += [(i, j, r + 1, m, p, t) for r, (t, m) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("cell_rows", [4, 512])
def test_hard_negatives_match_all_scores(spark, monkeypatch, cell_rows):
    prepare(spark)
    monkeypatch.setattr(multi_index, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(multi_index, "SHELF_ROWS", (16, 64))
    monkeypatch.setattr(multi_index, "QUERY_ROWS", (4, 8))
    rows = _rows()
    df = spark.createDataFrame([(*r, 7, "x", 1, 2) for r in rows], SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in multi_index.hard_negatives(df, F.col("id") % 10 == 0).collect())
    assert got == plain(rows, 10) and got


def test_repeated_ids_take_one_row_and_empty_tables_give_none(spark):
    prepare(spark)
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.5, 0.5], 2), (2, [0.75, 0.5], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = [tuple(r) for r in multi_index.hard_negatives(df, F.col("id") == 0).collect()]
    assert got == [(0, 1, 1, 2, 256 * 256, 192 * 256)]
    assert multi_index.hard_negatives(df.limit(0), F.col("id") == 0).collect() == []
    assert multi_index.hard_negatives(df, F.col("id") == 99).collect() == []


def test_cells_come_in_falling_order_once_each():
    rng = np.random.default_rng(0)
    one, two = rng.standard_normal(7), rng.standard_normal(5)
    seen = list(multi_index.cells_in_order(one, two))
    assert [b for b, _, _ in seen] == sorted((b for b, _, _ in seen), reverse=True)
    assert {(i, j) for _, i, j in seen} == {(i, j) for i in range(7) for j in range(5)} and len(seen) == 35
    assert all(abs(b - one[i] - two[j]) < 1e-12 for b, i, j in seen)


def test_a_certified_search_visits_few_cells_of_clustered_rows():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((16, 8)) * 300
    x = np.floor(np.repeat(centres, 50, axis=0) + rng.standard_normal((800, 8)) * 5)
    cut = 4
    books = [multi_index.codebook(p, 16, 0) for p in (x[:, :cut], x[:, cut:])]
    halves, cells = [], []
    for p, book in zip((x[:, :cut], x[:, cut:]), books):
        away = multi_index._distances(p, book)
        near = away.argmin(1)
        at = np.arange(len(x))
        radius = np.array([away[at, near][near == c].max(initial=0) for c in range(len(book))])
        norm = np.array([np.sqrt((p[near == c] ** 2).sum(1)).max(initial=0) for c in range(len(book))])
        halves.append(multi_index.Half(book, radius, norm))
        cells.append(near)
    index = multi_index.Index(tuple(halves), cut, np.zeros(len(books[0]), np.int64), np.ones(len(books[0]), np.int64))
    ids, labels = np.arange(len(x)), np.zeros(len(x), np.int64)
    wanted = [multi_index.Wanted(5, [-np.inf], [np.inf], [-np.inf])]
    visited = multi_index.search_shelf(index, x[:1], [0], [0], wanted, x, ids, labels, *cells, True)
    scores = sorted((-float(x[0] @ x[k]), k) for k in range(1, len(x)))[:5]
    assert wanted[0].found[0] == scores
    assert visited < len(np.unique(cells[0] * 100 + cells[1]))
