"""Exact top-k inner-product search over an M-tree of paged metric nodes.

Vectors become integers, floor(scale * x).  The tree has three levels.  Its nodes each have a routing
object taken from a bounded sample and hold the vectors nearest to it (a node's rows are dealt into
salted nodes of at most about ``NODE_ROWS``); a node's rows are split, by the two objects farthest
apart, into pages of at most ``PAGE_ROWS``.  Every node and page keeps its routing object, covering
radius and largest norm; pages and entries keep the distance to the object above them.

A search begins in the node that holds the query itself, which gives a first k-th best score.  Then
queries go, in blocks, past all nodes; a node, page or entry is passed over when the score that the
triangle inequality still allows,

    (|q|^2 + max |x|^2 - max(0, d(q, object) - radius)^2) / 2,

is below the k-th best so far; pages are first judged by their stored parent distance, with no
distance computed.  Pages are visited best bound first.  Bounds never rule out equal scores, so ties
go to the smaller id.

Defined results: vectors that are null, hold null or non-finite components or have another dimension
than the most common one take no part, neither as query nor as candidate; the query's own id is no
candidate, so rows that repeat it are none; null ids take no part; fewer than k candidates are all
returned; an empty table or query set gives no rows; other columns are ignored.  Components are
taken to fit 2**53 in sums of products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmetrics.llm.staging import stage

MAX_ROUTING = 256
NODE_ROWS = 2048
PAGE_ROWS = 64
QUERY_BLOCK = 512
NODE_BLOCK = 1024
SLACK = 1e-6


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, v (binary float64 of the integer components) of every row that takes part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(fine & (F.size(v) > 0))
    dim = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).first()

    def pack(batches):
        for b in batches:
            x = np.floor(scale * np.array(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "v"])

    return rows.where(F.size("v") == (dim["dim"] if dim else 0)).mapInArrow(
        pack, f"id {vectors.schema[id_col].dataType.simpleString()}, v binary")


def _matrix(column) -> np.ndarray:
    column = list(column)
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of two integer matrices (squares are exact)."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _split(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Rows in pages: promote two far objects, part the rest by the nearer one, until a page fits."""
    done, todo = [], [rows]
    while todo:
        r = todo.pop()
        if len(r) <= PAGE_ROWS:
            done.append(r)
            continue
        start = _distances(x[r[:1]], x[r])[0]
        far = int(start.argmax())
        other = _distances(x[r[far:far + 1]], x[r])[0]
        back = _distances(x[r[int(other.argmax())]][None, :], x[r])[0]
        left = other <= back
        if left.all() or not left.any():  # all objects equal
            left = np.arange(len(r)) < len(r) // 2
        todo += [r[left], r[~left]]
    return done


def _pages(group: pd.DataFrame, routing: np.ndarray) -> pd.DataFrame:
    """The pages of one node."""
    ids, x = group["id"].to_numpy(), _matrix(group["v"])
    top = routing[int(group["route"].iloc[0])]
    out = []
    for rows in _split(x, np.argsort(ids, kind="stable")):
        own = x[rows]
        middle = int(_distances(own.mean(0)[None, :], own)[0].argmin())
        away = _distances(own[middle:middle + 1], own)[0]
        out.append({"object": own[middle].tobytes(), "radius": float(away.max()),
                    "parent": float(_distances(top[None, :], own[middle:middle + 1])[0, 0]),
                    "norm": float((own * own).sum(1).max()), "ids": ids[rows].tolist(), "entries": own.tobytes(), "away": away.tobytes()})
    frame = pd.DataFrame(out)
    frame.insert(0, "route", group["route"].iloc[0])
    frame.insert(1, "salt", group["salt"].iloc[0])
    return frame


class _Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.found = [[] for _ in range(n)]

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.floor[q]
        if not keep.any():
            return
        merged = self.found[q] + list(zip((-scores[keep]).tolist(), ids[keep].tolist()))
        merged.sort()
        self.found[q] = merged[:self.k]
        if len(self.found[q]) == self.k:
            self.floor[q] = max(self.floor[q], -self.found[q][-1][0])


def _search(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, pages: pd.DataFrame, top: np.ndarray, k: int) -> _Best:
    """Best-first over the pages of one node, for a block of queries."""
    best = _Best(len(queries), k, floor.astype(np.float64).copy())
    square = (queries * queries).sum(1)
    to_top = _distances(queries, top[None, :])[:, 0]
    radius, parent, norm = (pages[c].to_numpy() for c in ("radius", "parent", "norm"))

    def allowed(lower: np.ndarray) -> np.ndarray:
        return (square[:, None] + norm[None, :] - np.maximum(lower - SLACK, 0) ** 2) / 2 + SLACK

    stored = allowed(np.abs(to_top[:, None] - parent[None, :]) - radius[None, :])
    objects = _matrix(pages["object"])
    order = np.argsort(-stored.max(0))
    for p in order.tolist():
        alive = np.flatnonzero(stored[:, p] >= best.floor)
        if not len(alive):
            continue
        to_object = _distances(queries[alive], objects[p:p + 1])[:, 0]
        bound = (square[alive] + norm[p] - np.maximum(to_object - radius[p] - SLACK, 0) ** 2) / 2 + SLACK
        near = bound >= best.floor[alive]
        alive, to_object = alive[near], to_object[near]
        if not len(alive):
            continue
        entries = np.frombuffer(pages["entries"].iloc[p], np.float64).reshape(-1, queries.shape[1])
        away, ids = np.frombuffer(pages["away"].iloc[p], np.float64), np.asarray(pages["ids"].iloc[p])
        lower = np.maximum(np.abs(to_object[:, None] - away[None, :]) - SLACK, 0)
        open_ = (square[alive][:, None] + (entries * entries).sum(1)[None, :] - lower ** 2) / 2 + SLACK >= best.floor[alive][:, None]
        open_ &= ids[None, :] != query_ids[alive][:, None]
        columns = np.flatnonzero(open_.any(0))
        if not len(columns):
            continue
        scores = queries[alive] @ entries[columns].T
        for row, q in enumerate(alive.tolist()):
            mine = open_[row, columns]
            if mine.any():
                best.offer(q, scores[row, mine], ids[columns[mine]])
    return best


def build(vectors: DataFrame, scale: int, id_col: str, vector_col: str):
    """(routing objects, pages, vectors with their node): the tree as staged tables."""
    rows = stage(integer_vectors(vectors, scale, id_col, vector_col), "integer_vectors")
    n = rows.count()
    wanted = int(min(MAX_ROUTING, max(1, n // NODE_ROWS)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").toArrow().column("v").to_pylist()
    routing = np.unique(_matrix(sample), axis=0) if sample else np.zeros((1, 1))
    id_kind = vectors.schema[id_col].dataType.simpleString()

    def route(batches):
        for b in batches:
            nearest = _distances(_matrix(b.column("v").to_pylist()), routing).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest.astype(np.int32))], names=["id", "v", "route"])

    routed = stage(rows.mapInArrow(route, f"id {id_kind}, v binary, route int"), "routed_vectors")
    salts = routed.groupBy("route").agg(F.ceil(F.count("*") / NODE_ROWS).cast("int").alias("salts"))  # MAX_ROUTING rows at most
    placed = routed.join(F.broadcast(salts), "route").withColumn(
        "salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "salts").cast("int")).drop("salts")
    placed = stage(placed, "placed_in_nodes")
    pages = placed.groupBy("route", "salt").applyInPandas(
        lambda g: _pages(g, routing),
        f"route int, salt int, object binary, radius double, parent double, norm double, ids array<{id_kind}>, entries binary, away binary")
    return routing, stage(pages, "pages"), placed


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row for which ``is_query`` holds.

    ``is_query`` is a condition on the column ``id``.
    """
    routing, pages, placed = build(vectors, scale, id_col, vector_col)
    id_kind = vectors.schema[id_col].dataType.simpleString()
    queries = placed.where(is_query).dropDuplicates(["id"])
    hits = f"query_id {id_kind}, vec_id {id_kind}, score long"

    def rows_of(best: _Best, query_ids: np.ndarray) -> pd.DataFrame:
        flat = [(q, i, int(-s)) for q, found in zip(query_ids.tolist(), best.found) for s, i in found]
        return pd.DataFrame(flat, columns=["query_id", "vec_id", "score"])

    # first, each query in its own node (in blocks: a node may hold any number of queries)
    def at_home(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": left["id"], "v": left["v"], "floor": -np.inf})
        x, ids = _matrix(left["v"]), left["id"].to_numpy()
        best = _search(x, ids, np.full(len(x), -np.inf), right.reset_index(drop=True), routing[int(right["route"].iloc[0])], k)
        return pd.DataFrame({"id": ids, "v": left["v"], "floor": best.floor})

    homes = queries.groupBy("route", "salt").cogroup(pages.groupBy("route", "salt"))
    known = stage(homes.applyInPandas(at_home, f"id {id_kind}, v binary, floor double"), "query_floors")

    # then past all nodes: blocks of queries by blocks of nodes
    nodes = stage(pages.groupBy("route", "salt").agg(F.max(F.col("parent") + F.col("radius")).alias("radius"), F.max("norm").alias("norm")), "nodes")
    blocks_q = max(1, -(-known.count() // QUERY_BLOCK))
    blocks_n = max(1, -(-nodes.count() // NODE_BLOCK))
    q_rows = known.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(blocks_q)).cast("int"))
    q_packed = q_rows.withColumn("nb", F.explode(F.sequence(F.lit(0), F.lit(blocks_n - 1))))
    n_packed = nodes.withColumn("nb", F.pmod(F.xxhash64("route", "salt"), F.lit(blocks_n)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(blocks_q - 1))))

    def admit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["id", "v", "floor", "qb", "route", "salt"])
        x = _matrix(left["v"])
        lower = np.maximum(_distances(x, routing[right["route"].to_numpy()]) - right["radius"].to_numpy()[None, :] - SLACK, 0)
        allowed = ((x * x).sum(1)[:, None] + right["norm"].to_numpy()[None, :] - lower ** 2) / 2 + SLACK
        q, n = np.nonzero(allowed >= left["floor"].to_numpy()[:, None])
        out = left[["id", "v", "floor", "qb"]].iloc[q].reset_index(drop=True)
        return out.assign(route=right["route"].to_numpy()[n], salt=right["salt"].to_numpy()[n])

    admitted = q_packed.groupBy("qb", "nb").cogroup(n_packed.groupBy("qb", "nb")).applyInPandas(
        admit, f"id {id_kind}, v binary, floor double, qb int, route int, salt int")
    # a node's pages go to the blocks of queries that its bound admits, and to no other
    admitted = stage(admitted, "admitted")
    wanted = admitted.select(F.col("qb").alias("b"), F.col("route").alias("r"), F.col("salt").alias("s")).distinct()
    spread = pages.join(wanted, (F.col("route") == F.col("r")) & (F.col("salt") == F.col("s"))).drop("r", "s")

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        ids = left["id"].to_numpy()
        best = _search(_matrix(left["v"]), ids, left["floor"].to_numpy(), right.reset_index(drop=True),
                       routing[int(right["route"].iloc[0])], k)
        return rows_of(best, ids)

    found = admitted.groupBy("qb", "route", "salt").cogroup(spread.groupBy("b", "route", "salt")).applyInPandas(visit, hits)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
