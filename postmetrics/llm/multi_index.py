"""Hard-negative mining over an inverted multi-index.

Vectors become integers, floor(scale * x), and are cut into two halves.  Each half has a codebook
(k-means on a bounded sample of rows, smallest id hash); a row lies in the cell of its nearest
centroids (i, j).  For a query q the score of any row of a cell is at most

    (q1 . c_i + |q1| radius_i) + (q2 . c_j + |q2| radius_j),

with the radii over *all* rows of a centroid.  A query sorts both half bounds and visits cells by
their sum, best first, from a heap (multi-sequence), until the next bound is below what it still
needs: the search is certified and exact.

Cells are kept on shelves: all cells of a range of first-half centroids, dealt by id hash over
several shelves where that range has too many rows.  A search has two rounds.  In the first every
query visits the shelf of its best first-half bound, which yields its floors; in the second only the
pairs (block of queries, shelf) that some bound still admits are brought together.

Mining: a query's positives are its best rows of the same label.  For each positive with score p the
negatives are the best rows of other labels with ``low`` * p <= 100 * score <= ``high`` * p; all
windows of a query are filled in one search, each with its own floor.

Defined results: rows with a null id, label or vector, null or non-finite components, or another
dimension than the most common one take no part; of rows that share an id the one with the smallest
label, then vector, stands for it; ties go to the smaller id; an anchor with fewer rows than asked
for returns all; windows of negative positives are empty; an empty table gives no rows; other columns
are ignored.  Components are taken to fit 2**53 in sums of products.

Codebooks have sqrt(rows / ``CELL_ROWS``) centroids a half, so cells do not grow with the table.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmetrics.llm.staging import drop, stage

CELL_ROWS = 512
SAMPLE_ROWS = 16_384
#: Rows of a shelf and queries of a block: a share of the table between these bounds.
SHELF_ROWS = (1_024, 65_536)
QUERY_ROWS = (1_024, 16_384)
LLOYD_STEPS = 8


def integer_rows(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, v (binary float64 of the integer components), one row per id that takes part."""
    v = F.col(vector_col).cast("array<double>")
    fine = (F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull()
            & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = vectors.where(fine).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(F.size("v") > 0)
    dim = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).first()

    def pack(batches):
        for b in batches:
            x = np.floor(scale * np.array(b.column(2).flatten(), np.float64).reshape(b.num_rows, -1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=["id", "label", "v"])

    kinds = [vectors.schema[c].dataType.simpleString() for c in (id_col, label_col)]
    packed = rows.where(F.size("v") == (dim["dim"] if dim else 0)).mapInArrow(pack, f"id {kinds[0]}, label {kinds[1]}, v binary")
    return packed.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


def codebook(x: np.ndarray, size: int, seed: int) -> np.ndarray:
    """At most ``size`` centroids of the rows of ``x`` (Lloyd's iteration)."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centroids = distinct[rng.permutation(len(distinct))[:size]].astype(np.float64)
    for _ in range(LLOYD_STEPS if len(distinct) > size else 0):
        nearest = _distances(x, centroids).argmin(1)
        held = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        centroids[held > 0] = sums[held > 0] / held[held > 0, None]
    return centroids


@dataclass
class Half:
    """One half's centroids, with the radius and the largest norm of the rows of each."""

    centroids: np.ndarray
    radius: np.ndarray
    norm: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of q . x for the rows x of every centroid, for every row q."""
        size = np.sqrt((q * q).sum(1))[:, None]
        bound = np.minimum(q @ self.centroids.T + size * self.radius[None, :], size * self.norm[None, :])
        return bound + 1e-3 + 1e-9 * np.abs(bound)  # scores are integers: rounding never hides one


@dataclass
class Index:
    """Codebooks and shelves; ``shelf_of[i]`` is the first shelf of a first-half centroid, ``salts[i]`` the
    number of shelves that its range is dealt over."""

    halves: tuple
    cut: int
    shelf_of: np.ndarray
    salts: np.ndarray

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :self.cut], x[:, self.cut:]

    def shelf_bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bound for the rows of every range of shelves, by row of q; ranges in order of shelf."""
        one, two = (h.bounds(p) for h, p in zip(self.halves, self.split(q)))
        starts = np.flatnonzero(np.concatenate(([True], self.shelf_of[1:] != self.shelf_of[:-1])))
        return np.maximum.reduceat(one, starts, axis=1) + two.max(1)[:, None]

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """First shelf and number of shelves of every range."""
        first, at = np.unique(self.shelf_of, return_index=True)
        return first, self.salts[at]


def _between(n: int, bounds: tuple[int, int]) -> int:
    return int(min(max(n, bounds[0]), bounds[1]))


def build(rows: DataFrame, n: int) -> tuple[Index, DataFrame]:
    """The index of ``n`` rows (``integer_rows``) and all rows with their cell and shelf (staged)."""
    sample = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toArrow().column("v"))
    cut, size = (sample.shape[1] + 1) // 2, int(np.ceil(np.sqrt(n / CELL_ROWS)))
    books = [codebook(part, size, seed) for seed, part in enumerate((sample[:, :cut], sample[:, cut:]))]

    def place(batches):
        for b in batches:
            x = _matrix(b.column("v"))
            columns = []
            for part, book in ((x[:, :cut], books[0]), (x[:, cut:], books[1])) if len(x) else ():
                away = _distances(part, book)
                nearest = away.argmin(1)
                columns += [pa.array(nearest, pa.int32()), pa.array(away[np.arange(len(x)), nearest]), pa.array(np.sqrt((part * part).sum(1)))]
            if columns:
                yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=["id", "label", "v", "i", "ri", "ni", "j", "rj", "nj"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]
    placed = stage(rows.mapInArrow(place, f"id {kinds[0]}, label {kinds[1]}, v binary, i int, ri double, ni double, j int, rj double, nj double"),
                   "placed")
    halves, counts = [], None
    for book, key, r, norm in ((books[0], "i", "ri", "ni"), (books[1], "j", "rj", "nj")):
        held = placed.groupBy(key).agg(F.max(r).alias("r"), F.max(norm).alias("n"), F.count("*").alias("rows")).collect()  # one a centroid
        radius, norms, number = np.zeros(len(book)), np.zeros(len(book)), np.zeros(len(book), np.int64)
        for h in held:
            # the matrix form of a distance loses some digits: widen by them
            radius[h[key]], norms[h[key]], number[h[key]] = h["r"] + 1e-6 * (1 + h["n"]), h["n"], h["rows"]
        halves.append(Half(book, radius, norms))
        counts = number if counts is None else counts
    most = _between(n // 32, SHELF_ROWS)
    shelf_of, salts, shelf, i = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    while i < len(counts):
        end, held = i + 1, counts[i]
        while end < len(counts) and held + counts[end] <= most:
            held += counts[end]
            end += 1
        shelf_of[i:end], salts[i:end] = shelf, max(1, -(-held // most))
        shelf += salts[i]
        i = end
    index = Index(tuple(halves), cut, shelf_of, salts)
    of = F.array(*[F.lit(int(s)) for s in shelf_of])[F.col("i")] if len(shelf_of) <= 64 else None
    if of is None:
        table = rows.sparkSession.createDataFrame([(k, int(s), int(t)) for k, (s, t) in enumerate(zip(shelf_of, salts))],
                                                  "i int, first long, salts long")
        dealt = placed.join(F.broadcast(table), "i")  # one row a centroid
        shelf_column = F.col("first") + F.pmod(F.xxhash64("id"), F.col("salts"))
    else:
        dealt = placed
        shelf_column = of + F.pmod(F.xxhash64("id"), F.array(*[F.lit(int(s)) for s in salts])[F.col("i")])
    return index, dealt.select("id", "label", "v", "i", "j", shelf_column.cast("long").alias("shelf"))


def cells_in_order(one: np.ndarray, two: np.ndarray):
    """(bound, a, b) for all pairs of positions, by falling sum of the half bounds (multi-sequence)."""
    first, second = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
    u, v = one[first], two[second]
    heap = [(-(u[0] + v[0]), 0, 0)] if len(u) and len(v) else []
    while heap:
        bound, x, y = heapq.heappop(heap)
        yield -bound, int(first[x]), int(second[y])
        if y + 1 < len(v):
            heapq.heappush(heap, (-(u[x] + v[y + 1]), x, y + 1))
        if y == 0 and x + 1 < len(u):
            heapq.heappush(heap, (-(u[x + 1] + v[0]), x + 1, 0))


class Wanted:
    """The k best rows of one query in each of its windows [low, high]; ``floor`` is what a row must reach."""

    def __init__(self, k: int, lows, highs, floors):
        self.k = k
        self.low, self.high = np.asarray(lows, np.float64), np.asarray(highs, np.float64)
        self.floor = np.maximum(np.asarray(floors, np.float64), self.low)
        self.found = [[] for _ in self.low]

    def needs(self) -> float:
        return float(self.floor.min()) if len(self.floor) else np.inf

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for w in range(len(self.low)):
            keep = (scores >= self.floor[w]) & (scores <= self.high[w])
            if keep.any():
                merged = heapq.nsmallest(self.k, self.found[w] + list(zip((-scores[keep]).tolist(), ids[keep].tolist())))
                self.found[w] = merged
                if len(merged) == self.k:
                    self.floor[w] = max(self.floor[w], -merged[-1][0])


def search_shelf(index: Index, queries: np.ndarray, query_ids, query_labels, wanted: list[Wanted], x: np.ndarray, ids: np.ndarray,
                 labels: np.ndarray, i: np.ndarray, j: np.ndarray, same: bool) -> int:
    """Fill ``wanted`` from the rows of one shelf; returns the number of cells that were visited."""
    order = np.lexsort((j, i))
    x, ids, labels, i, j = x[order], ids[order], labels[order], i[order], j[order]
    firsts, seconds = np.unique(i), np.unique(j)
    key = np.searchsorted(firsts, i) * len(seconds) + np.searchsorted(seconds, j)
    edges = np.searchsorted(key, np.arange(len(firsts) * len(seconds) + 1))
    one, two = (h.bounds(p) for h, p in zip(index.halves, index.split(queries)))
    one, two = one[:, firsts], two[:, seconds]
    own_label = {label: (labels == label) == same for label in set(query_labels)}
    place_of = {i: at for at, i in enumerate(ids.tolist())}
    visited = 0
    for q in range(len(queries)):
        mine, query, fits = wanted[q], queries[q], own_label[query_labels[q]]
        own = place_of.get(query_ids[q]) if same else None  # its own row is no candidate
        for bound, a, b in cells_in_order(one[q], two[q]):
            needed = mine.needs()
            if bound < needed:  # certified: no later cell holds a better row
                break
            low, high = edges[a * len(seconds) + b], edges[a * len(seconds) + b + 1]
            if low == high:
                continue
            visited += 1
            scores = x[low:high] @ query
            at = np.flatnonzero(fits[low:high] & (scores >= needed))
            if own is not None and low <= own < high:
                at = at[at != own - low]
            if len(at):
                mine.offer(scores[at], ids[low + at])
    return visited


def _requests(index: Index, anchors: DataFrame, blocks: int, home: bool) -> DataFrame:
    """Rows of ``anchors`` with (shelf, qb): its home shelf, or every other one that a bound admits."""
    first, salts = index.ranges()

    def run(batches):
        for b in batches:
            x = _matrix(b.column("v"))
            if not len(x):
                continue
            bounds = index.shelf_bounds(x)
            own = first[bounds.argmax(1)] + np.asarray(b.column("deal")) % salts[bounds.argmax(1)]
            if home:
                row, shelf = np.arange(len(x)), own
            else:
                needs = np.array([min(f, default=np.inf) for f in b.column("floors").to_pylist()])
                q, r = np.nonzero(bounds >= needs[:, None])
                row, start = np.repeat(q, salts[r]), np.repeat(np.cumsum(salts[r]) - salts[r], salts[r])
                shelf = np.repeat(first[r], salts[r]) + np.arange(len(row)) - start
                row, shelf = row[shelf != own[row]], shelf[shelf != own[row]]
            step = 1 << 14
            for at in range(0, len(row), step):  # an anchor may ask for any number of shelves
                taken = b.take(pa.array(row[at:at + step]))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(shelf[at:at + step], pa.int64())], names=[*b.schema.names, "shelf"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema) + ", deal long"
    dealt = anchors.withColumn("deal", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)))
    return dealt.mapInArrow(run, f"{columns}, shelf long").withColumn("qb", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int")).drop("deal")


def _visit(index: Index, shelved: DataFrame, requests: DataFrame, k: int, same: bool) -> DataFrame:
    """query_id, window, id, score: the k best rows of each request's shelf in each window."""
    kind = requests.schema["id"].dataType.simpleString()
    pairs = requests.select(F.col("shelf").alias("asked"), F.col("qb").alias("block")).distinct()
    rows = shelved.join(pairs, F.col("shelf") == F.col("asked")).select("id", "label", "v", "i", "j", "asked", "block")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids = left.column("id").to_pylist()
            wanted = [Wanted(k, *w) for w in zip(*(left.column(c).to_pylist() for c in ("lows", "highs", "floors")))]
            search_shelf(index, _matrix(left.column("v")), ids, left.column("label").to_pylist(), wanted, _matrix(right.column("v")),
                         *(right.column(c).to_numpy() for c in ("id", "label", "i", "j")), same)
            out = [(q, w, i, int(-s)) for q, want in zip(ids, wanted) for w, found in enumerate(want.found) for s, i in found]
        columns = list(zip(*out)) or [(), (), (), ()]
        id_kind = left.schema.field("id").type
        return pa.table({"query_id": pa.array(columns[0], id_kind), "window": pa.array(columns[1], pa.int32()),
                         "id": pa.array(columns[2], id_kind), "score": pa.array(columns[3], pa.int64())})

    return requests.groupBy("shelf", "qb").cogroup(rows.groupBy("asked", "block")).applyInArrow(
        run, f"query_id {kind}, window int, id {kind}, score long")


def best_in_windows(index: Index, shelved: DataFrame, anchors: DataFrame, k: int, same: bool, blocks: int) -> DataFrame:
    """query_id, window, rank (from 1), id, score: the k best rows in every window of every anchor.

    ``anchors``: id, label, v, lows, highs (arrays, one entry a window); ``same``: rows of the anchor's
    label, or of all others.
    """
    homes = stage(_requests(index, anchors.withColumn("floors", F.col("lows")), blocks, True), "home_requests")
    first = stage(_visit(index, shelved, homes, k, same), "home_hits")
    full = first.groupBy("query_id", "window").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") >= k)
    floors = full.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("window", F.col("s")[k - 1].cast("double")))).alias("floor_of"))
    known = anchors.join(floors, anchors["id"] == floors["query_id"], "left").withColumn(
        "floors", F.transform("lows", lambda low, w: F.coalesce(F.col("floor_of")[w.cast("int")], low)))
    asked = stage(_requests(index, known.select(*anchors.columns, "floors"), blocks, False), "requests")
    found = first.unionByName(_visit(index, shelved, asked, k, same))
    order = Window.partitionBy("query_id", "window").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = stage(best.select("query_id", "window", F.col("rank").cast("int").alias("rank"), "id", "score"), "best_in_windows")
    drop(homes, first, asked)
    return out


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``id``; ``low`` and ``high`` are percents of the positive's score.
    """
    rows = stage(integer_rows(vectors, scale, id_col, vector_col, label_col), "integer_rows")
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    kind = rows.schema["id"].dataType.simpleString()
    if not sizes["anchors"]:
        return rows.sparkSession.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, "
                                                     "positive_score long, negative_score long")
    index, dealt = build(rows, sizes["n"])
    shelved = stage(dealt, "shelved")
    blocks = -(-sizes["anchors"] // _between(sizes["anchors"] // 4, QUERY_ROWS))
    anchors = stage(rows.where(is_anchor), "anchors")

    everything = [F.array(F.lit(end).cast("double")).alias(name) for end, name in ((float("-inf"), "lows"), (float("inf"), "highs"))]
    near = best_in_windows(index, shelved, anchors.select("*", *everything), positives, True, blocks)
    near = near.select(F.col("query_id").alias("anchor_id"), F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    lows, highs = F.ceil(F.col("positive_score") * low / 100), F.floor(F.col("positive_score") * high / 100)
    listed = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(
        "place", lows.cast("double").alias("low"), highs.cast("double").alias("high")))).alias("w"))
    windowed = anchors.join(listed, anchors["id"] == listed["anchor_id"]).select(
        "id", "label", "v", F.transform("w", lambda t: t["low"]).alias("lows"), F.transform("w", lambda t: t["high"]).alias("highs"))
    far = best_in_windows(index, shelved, windowed, negatives, False, blocks)
    far = far.select(F.col("query_id").alias("anchor_id"), (F.col("window") + 1).alias("place"), "rank", F.col("id").alias("negative_id"),
                     F.col("score").alias("negative_score"))
    # floating bounds of a window may round: the exact condition in integers decides
    fits = (low * F.col("positive_score") <= 100 * F.col("negative_score")) & (100 * F.col("negative_score") <= high * F.col("positive_score"))
    return near.join(far, ["anchor_id", "place"]).where(fits).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
