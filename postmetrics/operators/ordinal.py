"""Positions in a total order without a single-partition window.

``row_number().over(Window.orderBy(...))`` without a partition key moves every
row into one task, and ``partitionBy(g)`` does the same for a hot group ``g``
(one group may hold a third of all rows).  Instead we

1. sort globally with a *unique* key (range partitioning splits even a hot
   group, because the tie-break makes every key distinct),
2. tag each row with its partition id and ``monotonically_increasing_id``
   (partition id in the upper bits, position in the partition in the lower 33),
3. write the tagged rows once to the shared checkpoint folder (fixes the layout,
   cuts the lineage, survives executor loss),
4. add per-partition offsets (one row per partition: a proven-small broadcast).

Group-relative positions subtract the group's first global index, obtained by
a partial (map-side combined) aggregate.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmetrics.session import materialize

_PID = "_pm_pid"
_MONO = "_pm_mono"
_OFF = "_pm_off"
_FIRST, _LAST = "_pm_first", "_pm_last"


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def with_global_index(df: DataFrame, order: Sequence, index_col: str = "_idx",
                      checkpoint: bool = True) -> DataFrame:
    """Append the 0-based position of each row in ``order`` (which must be total)."""
    tagged = (df.orderBy(*_cols(order))
              .withColumn(_PID, F.spark_partition_id())
              .withColumn(_MONO, F.monotonically_increasing_id()))
    if checkpoint:
        tagged = materialize(tagged, "ordinal")
    # one row per partition: bounded by the partition count, safe to broadcast
    counts = tagged.groupBy(_PID).agg(F.count(F.lit(1)).alias("_pm_n"))
    offsets = counts.select(
        _PID,
        F.coalesce(F.sum("_pm_n").over(Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias(_OFF))
    local = F.col(_MONO) - F.shiftleft(F.col(_PID).cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), _PID)
            .withColumn(index_col, F.col(_OFF) + local)
            .drop(_PID, _MONO, _OFF))


def with_group_position(df: DataFrame, groups: Sequence[str], order: Sequence,
                        pos_col: str = "_pos", size_col: str | None = "_n",
                        checkpoint: bool = True) -> DataFrame:
    """0-based position inside each group (``row_number() - 1``) and the group size.

    ``order`` must make rows unique inside a group.  Works when one group holds
    most of the rows: no task sees more than its range-partition slice.
    """
    groups = list(groups)
    idx = with_global_index(df, [*_cols(groups), *_cols(order)], "_pm_gidx", checkpoint)
    aggs = [F.min("_pm_gidx").alias("_pm_start")]
    if size_col:
        aggs.append(F.count(F.lit(1)).alias(size_col))
    starts = idx.groupBy(*groups).agg(*aggs)
    out = idx.join(starts, on=[idx[g].eqNullSafe(starts[g]) for g in groups], how="inner")
    for g in groups:
        out = out.drop(starts[g])
    return out.withColumn(pos_col, F.col("_pm_gidx") - F.col("_pm_start")).drop("_pm_gidx", "_pm_start")


def row_tiebreak(*cols: str) -> Column:
    """A deterministic per-row tie-break from the row's own values."""
    return F.xxhash64(*[F.col(c) for c in cols])


#: Rows around the wanted positions that the driver may hold; more of them are positioned by a sort.
FEW = 10_000
SKETCH_ACCURACY = 10_000


def sketch_edges(probs: Sequence[float], accuracy: int = SKETCH_ACCURACY) -> list[float]:
    """The probabilities on both sides of each of ``probs`` that a sketch has to answer for ``select_rows``."""
    eps = 3.0 / accuracy
    return sorted({min(1.0, max(0.0, q + d)) for q in probs for d in (-eps, eps)})


def select_rows(df: DataFrame, key: str, tie: str, positions: list[int], accuracy: int = SKETCH_ACCURACY,
                n: int | None = None, sketch: dict | None = None):
    """Exact rows at 0-based ``positions`` of the ascending (key, tie) order, without a
    full sort: a ``percentile_approx`` sketch brackets each position, one pass counts
    the rows below each bracket, and only the rows inside the brackets are ranked.

    Returns a list of (key, tie) tuples (one per position, bounded by ``len(positions)``),
    or ``None`` when a bracket missed its position (the caller then sorts everything).
    ``key`` must be a non-null double; ``tie`` unique.  ``n`` and ``sketch`` (value at every edge of
    ``sketch_edges``) spare a pass if the caller has them, with ``probs`` close to the positions.
    """
    n = df.count() if n is None else n
    if n == 0 or not positions:
        return []
    k = F.col(key)
    if sketch is None:
        probs = [p / max(n - 1, 1) for p in positions]
        edges = sketch_edges(probs, accuracy)
        sketch = dict(zip(edges, df.agg(F.percentile_approx(key, edges, accuracy)).first()[0]))
    else:
        edges, probs = sorted(sketch), [p / max(n - 1, 1) for p in positions]
    bands = []
    for q in probs:  # the nearest edges on both sides
        low = max((e for e in edges if e <= q - 1.0 / accuracy), default=edges[0])
        high = min((e for e in edges if e >= q + 1.0 / accuracy), default=edges[-1])
        bands.append((sketch[low], sketch[high]))
    inside = None
    for lo, hi in bands:
        c = (k >= F.lit(lo)) & (k <= F.lit(hi))
        inside = c if inside is None else inside | c
    counts = df.agg(*[F.count_if(k < F.lit(lo)) for lo, _ in bands],
                    *[F.count_if((k >= F.lit(lo)) & (k <= F.lit(hi))) for lo, hi in bands],
                    *[F.count_if(inside & (k < F.lit(lo))) for lo, _ in bands], F.count_if(inside)).first()
    m = len(bands)
    below, width, offset, total = counts[:m], counts[m:2 * m], counts[2 * m:3 * m], counts[3 * m]
    if any(not (c <= p < c + w) for p, c, w in zip(positions, below, width)):
        return None
    wanted = [p - c + o for p, c, o in zip(positions, below, offset)]
    band = df.where(inside).select(key, tie)
    if total <= FEW:
        rows = band.orderBy(key, tie).collect()
        return [(rows[w][key], rows[w][tie]) for w in wanted]
    ranked = with_global_index(band, [F.col(key), F.col(tie)], "_b")
    got = {r["_b"]: (r[key], r[tie]) for r in ranked.where(F.col("_b").isin(wanted)).collect()}
    return [got[w] for w in wanted]


def with_previous(df: DataFrame, order: Sequence, cols: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Columns of the previous row in a total ``order`` (a distributed global ``lag``).

    Rows are range-partitioned and sorted by the order, and one pass over each sorted partition
    carries every row's predecessor to it while the rows are written; so the sort's exchange is
    the only one.  The first row of a partition takes the last row of the preceding non-empty
    partition from a table with one row per partition (a bounded broadcast).
    """
    spark = df.sparkSession
    kinds = {c: df.schema[c].dataType for c in cols}
    schema = T.StructType(list(df.schema.fields) + [T.StructField(prefix + c, t) for c, t in kinds.items()]
                          + [T.StructField(_PID, T.IntegerType()), T.StructField(_FIRST, T.BooleanType()), T.StructField(_LAST, T.BooleanType())])

    def carry(batches):
        pid, last, held = TaskContext.get().partitionId(), None, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            shifted = []
            for c in cols:
                column = b.column(c)
                before = pa.nulls(1, column.type) if last is None else last[c]
                shifted.append(pa.concat_arrays([before, column.slice(0, n - 1)]))
            flags = np.zeros(n, bool)
            flags[0] = last is None
            last = {c: b.column(c).slice(n - 1, 1) for c in cols}
            if held is not None:
                yield _flagged(*held, False)
            held = (b, shifted, pid, flags)
        if held is not None:
            yield _flagged(*held, True)

    def _flagged(b, shifted, pid, first, is_end):
        end = np.zeros(b.num_rows, bool)
        end[-1] = is_end
        return pa.RecordBatch.from_arrays(
            [*b.columns, *shifted, pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(first), pa.array(end)],
            names=[*b.schema.names, *[prefix + c for c in cols], _PID, _FIRST, _LAST])

    rows = materialize(df.orderBy(*_cols(order)).mapInArrow(carry, schema), "ordinal-prev")
    ends = rows.where(F.col(_LAST)).select(_PID, *cols).toArrow().sort_by(_PID)  # one row per partition
    carried = pa.table([ends.column(_PID).slice(1), *[ends.column(c).slice(0, max(ends.num_rows - 1, 0)) for c in cols]],
                       names=["_pm_p", *[f"_pm_{c}" for c in cols]])
    border_schema = T.StructType([T.StructField("_pm_p", T.IntegerType())] + [T.StructField(f"_pm_{c}", t) for c, t in kinds.items()])
    border = spark.createDataFrame(carried, border_schema)
    j = rows.join(F.broadcast(border), (F.col(_PID) == F.col("_pm_p")) & F.col(_FIRST), "left")
    return j.select(*[F.col(c) for c in df.columns],
                    *[F.when(F.col(_FIRST), F.col(f"_pm_{c}")).otherwise(F.col(prefix + c)).alias(prefix + c) for c in cols])
