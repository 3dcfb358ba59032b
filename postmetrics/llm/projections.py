"""Near-duplicate vectors by counting collisions on one-dimensional projections inside cells.

Unit vectors are projected on many random directions.  Two vectors collide on a projection when one
lies in the window of half-width ``window`` centred on the other.  Vectors at the wanted cosine
collide on each projection with a known probability, so a pair must collide on at least
``min_collisions`` of them; that count is calibrated to miss at most ``MISS`` of the pairs at the
threshold, and only pairs that reach it are verified by their cosine in double precision.

Pairs are only looked for inside cells.  A cell of a table is a range of values (below or above the
sampled median) on each of ``bits`` projections; a vector within ``margin`` of a median belongs to
both ranges.  The number of tables is calibrated to ``RECALL`` from the chance that a pair at the
threshold shares a cell of one, given the sampled spread of the projections about their medians (vectors
that all point one way lie close to every median); of several margins the one with the fewest copies of
a vector is taken.  ``bits`` grows with the logarithm of the number of vectors, which keeps cells small.  A pair is counted once: in its first common table, in the lowest common cell.

Equal vectors are collapsed first and counted by their number.  A cell with more than ``BLOCK`` rows
is compared in pairs of blocks, each its own group, so no task holds more than two blocks; tasks
return one row per linked vector, never the pairs.

Defined results: null and zero vectors, those with null or non-finite components and those of another
dimension than the most common one link with nothing (n_links 0, their own component); a null id is
kept, with a null component; repeated rows count as vectors of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmetrics.llm.components import connected_components
from postmetrics.llm.staging import stage

RECALL = 0.997
MISS = 1e-4
WINDOW_SHARE = 0.90
MARGINS = tuple(k / 40 for k in range(1, 25))
CELL_ROWS = 128
MAX_BITS = 24
MIN_COUNTED, MAX_COUNTED = 40, 96
BLOCK = 1024
SAMPLE = 4096


@dataclass(frozen=True)
class Plan:
    """Calibrated parameters for one cosine threshold and number of vectors."""

    min_cosine: float
    bits: int
    tables: int
    window: float
    min_collisions: int
    margin: float

    @property
    def projections(self) -> int:
        return max(MIN_COUNTED, self.bits * self.tables)

    @property
    def counted(self) -> int:
        """Projections whose collisions are counted (the first ones)."""
        return min(MAX_COUNTED, self.projections)


def _normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _tables(distance: float, spread: float, bits: int, margin: float) -> int:
    """Tables that keep a pair at ``distance`` together in one of them with chance RECALL."""
    # a projection parts a pair whose values lie on both sides of the median, further than the margin
    sigma = distance / 2
    h = margin / sigma
    beyond = 2 * sigma * (math.exp(-h * h / 2) / math.sqrt(2 * math.pi) - h * (1 - _normal_cdf(h)))
    together = max(0.0, 1 - 2 * beyond / (math.sqrt(2 * math.pi) * spread)) ** bits
    if together >= RECALL:
        return 1
    return math.ceil(math.log(1 - RECALL) / math.log(1 - together)) if together > 1e-9 else 1 << 30


def calibrate(min_cosine: float, n: int, spread: float = 1.0) -> Plan:
    """``spread``: standard deviation of the projections about their medians."""
    distance = math.sqrt(2 - 2 * min_cosine)
    bits = min(MAX_BITS, max(1, math.ceil(math.log2(max(n, 2) / CELL_ROWS)))) if n > CELL_ROWS else 1
    spread = max(spread, distance / 20)

    def copies(margin: float) -> float:
        near = 2 * _normal_cdf(margin / spread) - 1
        return _tables(distance, spread, bits, margin) * (2 + (1 + near) ** bits)
    margin = min(MARGINS, key=copies)
    tables = _tables(distance, spread, bits, margin)
    lo, hi = 0.0, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 2 * _normal_cdf(mid) - 1 < WINDOW_SHARE else (lo, mid)
    m = min(MAX_COUNTED, max(MIN_COUNTED, bits * tables))
    tail, least = 0.0, 0
    for k in range(m + 1):
        tail += math.comb(m, k) * WINDOW_SHARE ** k * (1 - WINDOW_SHARE) ** (m - k)
        if tail > MISS:
            least = k
            break
    return Plan(min_cosine, bits, tables, hi * distance, least, margin)


def directions(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng(20_240_501).standard_normal((dim, n))


def sampled_spread(units: np.ndarray) -> float:
    """Spread of 64 projections of the sample about their medians (root mean square)."""
    values = units @ directions(units.shape[1], 64)
    return float(np.sqrt(np.mean((values - np.median(values, axis=0)) ** 2)))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (binary of the components as float64): rows that can link with something."""
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(fine)
    dim = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).first()

    def pack(batches):
        for b in batches:
            x = np.array(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "v"])

    kind = vectors.schema[id_col].dataType.simpleString()
    rows = rows.where(F.size("v") == (dim["dim"] if dim else 0))
    return rows.mapInArrow(pack, f"id {kind}, v binary")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def _codes(values: np.ndarray, medians: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Per row and table: the bits above the median, and those within the margin of it."""
    off = (values - medians)[:, :plan.bits * plan.tables].reshape(len(values), plan.tables, plan.bits)
    weight = 1 << np.arange(plan.bits, dtype=np.int64)
    return ((off > 0) * weight).sum(2), ((np.abs(off) <= plan.margin) * weight).sum(2)


def _cells_of(code: int, near: int) -> list[int]:
    """Every cell a vector belongs to: its margin bits take both values."""
    cells, free = [code & ~near], near
    while free:
        bit = free & -free
        free ^= bit
        cells += [c | bit for c in cells]
    return cells


def _components(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable for every row of a square boolean matrix."""
    label = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(reach, label[None, :], len(linked)).min(1)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _compare(rows: pd.DataFrame, plan: Plan, dim: int, same_block: bool) -> pd.DataFrame:
    """Linked vectors of one cell (or of two blocks of it): id, links, root."""
    rows = rows.sort_values("id").reset_index(drop=True)
    x = _unit(_matrix(rows["v"], dim))
    values = (x @ directions(dim, plan.projections)[:, :plan.counted]).astype(np.float32)
    side = np.zeros(len(rows), np.int8) if same_block else (rows["blk"] == rows["i"]).to_numpy().astype(np.int8)
    code = np.stack(rows["code"].to_numpy()).astype(np.int64)
    near = np.stack(rows["near"].to_numpy()).astype(np.int64)
    table, cell = int(rows["tbl"].iloc[0]), int(rows["cell"].iloc[0])

    hits = np.zeros((len(x), len(x)), np.int16)
    for k in range(plan.counted):
        hits += np.abs(values[:, k][:, None] - values[:, k][None, :]) <= np.float32(plan.window * 1.0001)
    a, b = np.nonzero(np.triu(hits >= plan.min_collisions, 1))
    if not same_block:
        keep = side[a] != side[b]
        a, b = a[keep], b[keep]
    # the lowest common cell of this table, and no common cell in an earlier table
    first = (near[a, table] & near[b, table] & cell) == 0
    for t in range(table):
        first &= ((code[a, t] ^ code[b, t]) & ~near[a, t] & ~near[b, t]) != 0
    a, b = a[first], b[first]
    close = np.einsum("ij,ij->i", x[a], x[b]) >= plan.min_cosine
    a, b = a[close], b[close]
    own, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    linked = np.zeros((len(own), len(own)), bool)
    ia, ib = inverse[:len(a)], inverse[len(a):]
    linked[ia, ib] = linked[ib, ia] = True
    ids, weight = rows["id"].to_numpy()[own], rows["copies"].to_numpy()[own]
    links = np.bincount(ia, weight[ib], len(own)) + np.bincount(ib, weight[ia], len(own)) if len(own) else np.zeros(0)
    return pd.DataFrame({"id": ids, "links": links.astype(np.int64), "root": ids[_components(linked)] if len(own) else ids})


def near_duplicates(vectors: DataFrame, min_cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept: one row for every row of ``vectors``."""
    members = stage(valid_vectors(vectors, id_col, vector_col).where("id IS NOT NULL"), "unit_vectors")
    distinct = stage(members.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "distinct_vectors")
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
    dim = len(sample[0]) // 8 if sample else 1
    plan = calibrate(min_cosine, n, sampled_spread(_unit(_matrix(sample, dim))) if sample else 1.0)
    medians = np.median(_unit(_matrix(sample, dim)) @ directions(dim, plan.projections), axis=0) if sample else np.zeros(plan.projections)

    def assign(batches):
        a = directions(dim, plan.projections)
        for b in batches:
            code, near = _codes(_unit(_matrix(b.column("v").to_pylist(), dim)) @ a, medians, plan)
            for t in range(plan.tables):
                cells = [_cells_of(int(c), int(m)) for c, m in zip(code[:, t], near[:, t])]
                size = np.array([len(c) for c in cells])
                for lo in range(0, len(cells), 200):
                    hi = min(lo + 200, len(cells))
                    take = pa.array(np.repeat(np.arange(lo, hi), size[lo:hi]))
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id").take(take), b.column("v").take(take), b.column("copies").take(take),
                         pa.array(list(code)).take(take), pa.array(list(near)).take(take), pa.array(np.full(len(take), t, np.int32)),
                         pa.array(np.concatenate(cells[lo:hi]).astype(np.int64))],
                        names=["id", "v", "copies", "code", "near", "tbl", "cell"])

    kind = vectors.schema[id_col].dataType.simpleString()
    placed = distinct.select("id", "v", "copies").mapInArrow(
        assign, f"id {kind}, v binary, copies long, code array<long>, near array<long>, tbl int, cell long")
    placed = stage(placed, "placed_vectors")
    sizes = stage(placed.groupBy("tbl", "cell").count().where("count > 1"), "cell_sizes")
    sized = placed.join(sizes, ["tbl", "cell"])
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    sized = sized.withColumn("blocks", blocks).withColumn("blk", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    pairs = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("i", F.least("blk", "other")).withColumn("j", F.greatest("blk", "other")).drop("other", "blocks", "count")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return _compare(group, plan, dim, bool(group["i"].iloc[0] == group["j"].iloc[0]))

    found = stage(pairs.groupBy("tbl", "cell", "i", "j").applyInPandas(compare, f"id {kind}, links long, root {kind}"), "found_links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    reps = distinct.select("v", "id", "copies").join(links, "id", "left").join(
        component.select(F.col("vertex").alias("id"), "component"), "id", "left").select(
        "v", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    # one row for each row of the input; equal rows have equal results
    per_row = members.join(reps, "v").groupBy("id").agg(
        F.max(F.col("links") + F.col("copies") - 1).alias("n_links"), F.min("component").alias("component"))
    out = vectors.select(F.col(id_col).alias("_id")).join(per_row, F.col("_id") == F.col("id"), "left")
    own = F.coalesce("component", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      own.alias("component_id"), F.coalesce(own == F.col("_id"), F.lit(True)).alias("kept"))
