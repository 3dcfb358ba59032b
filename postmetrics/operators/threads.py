"""Conversation threads: root per post by pointer doubling, position inside the thread.

Reference semantics kept:
* the root is the first ancestor that is not itself a reply in the archive, so a
  parent missing from the archive becomes the ``thread_id`` (T8);
* duplicate ids: the latest row's parent wins (``last_wins_order``);
* cycles: the smallest id on the cycle is the root (the reference's choice there
  depends on visiting order);
* the earliest archived member gets step 0 (ties by id).

Scale: each doubling round is one equi-join of the active pointers against the
pointer table (AQE splits a hot root's partition), about log2(depth)+1 rounds,
each written to the shared checkpoint folder so lineage stays short and a
lost executor only recomputes one round.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from postmetrics.operators.ordinal import with_group_position
from postmetrics.session import scratch_path


def parent_edges(df: DataFrame, id_col: str, parent_col: str, last_wins_order: Sequence[str] = ()) -> DataFrame:
    """(id, parent) for replying rows; duplicate ids keep the parent of the latest row."""
    rows = df.where(F.col(parent_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(parent_col).cast("string").alias("parent"),
        *[F.col(c) for c in last_wins_order])
    if last_wins_order:
        pick = F.max_by(F.col("parent"), F.struct(*[F.col(c) for c in last_wins_order], F.col("parent")))
    else:
        pick = F.max(F.col("parent"))
    return rows.groupBy("id").agg(pick.alias("parent"))


def thread_roots(df: DataFrame, id_col: str, parent_col: str, last_wins_order: Sequence[str] = ()) -> DataFrame:
    """(id, thread_id) for every distinct id of ``df`` (ids as strings).

    Each node carries a pointer ``ptr`` (initially its parent), the smallest id
    seen along the pointer path ``mn`` and a ``done`` flag.  A node is done when
    its pointer reaches a thread root: a non-reply node, an id outside the
    archive, or a node already done (whose pointer is final).  Otherwise the
    pointer jumps to the pointed node's pointer (path length doubles).  Only the
    active nodes are joined each round.  Every round finishes some nodes while any
    acyclic one is left (a chain has a node at each depth), so once the number of
    active nodes stops falling all of them lie on, or lead into, a cycle; after
    log2 of that number of rounds the running minima cover the cycles.
    """
    spark = df.sparkSession
    edges = parent_edges(df, id_col, parent_col, last_wins_order)
    ids = df.select(F.col(id_col).cast("string").alias("id")).where(F.col("id").isNotNull()).distinct()
    # pointers only ever move to ancestors, i.e. to ids that are someone's parent: only those
    # "target" nodes are needed on the lookup side of a round (leaves never are)
    targets = edges.select(F.col("parent").alias("id")).distinct().withColumn("_t", F.lit(True))
    base = ids.join(edges, "id", "left").join(targets, "id", "left").select(
        "id",
        F.coalesce("parent", "id").alias("ptr"),
        F.least(F.col("id"), F.coalesce("parent", "id")).alias("mn"),
        F.col("parent").isNull().alias("is_root"),
        F.coalesce(F.col("_t"), F.lit(False)).alias("is_target"),
        F.col("parent").isNull().alias("done"))
    # Every round is written once, partitioned by ``done``: resolved rows are never
    # rewritten (later rounds read them by partition pruning); only the shrinking
    # active set feeds the next round.
    written, n_active = _write_round(base)
    rounds, active = [written], written.where(~F.col("done"))
    r, before = 0, None
    while True:
        if n_active == 0 or (n_active == before and 2 ** r >= 2 * n_active):
            break
        before = n_active
        r += 1
        look = _resolved(rounds).unionByName(active).where(F.col("is_target")).select(
            F.col("id").alias("_lid"), F.col("ptr").alias("_lptr"), F.col("mn").alias("_lmn"),
            F.col("is_root").alias("_lroot"), F.col("done").alias("_ldone"))
        # only the nodes that active ones point at: this cuts the lookup before the join moves it
        wanted = active.select(F.col("ptr").alias("_lid")).distinct()
        look = look.join(wanted, "_lid", "left_semi")
        step = active.join(look, active["ptr"] == look["_lid"], "left")
        at_root = F.col("_lid").isNull() | F.col("_lroot")
        finished = at_root | F.col("_ldone")
        written, n_active = _write_round(step.select(
            "id",
            F.when(at_root, F.col("ptr")).otherwise(F.col("_lptr")).alias("ptr"),
            F.when(finished, F.col("mn")).otherwise(F.least(F.col("mn"), F.col("_lmn"))).alias("mn"),
            F.col("is_root"), F.col("is_target"),
            finished.alias("done")))
        rounds.append(written)
        active = written.where(~F.col("done"))
    resolved = _resolved(rounds).select("id", F.col("ptr").alias("thread_id"))
    if n_active == 0:
        return resolved
    # still active: nodes on (or leading into) a cycle.  After the rounds the pointer sits
    # on the cycle, and that node's running minimum covers exactly the cycle.
    look = (_resolved(rounds).unionByName(active).where(F.col("is_target"))
            .select(F.col("id").alias("_lid"), F.col("mn").alias("_lmn")))
    cyc = active.join(look, active["ptr"] == look["_lid"], "left").select("id", F.col("_lmn").alias("thread_id"))
    return resolved.unionByName(cyc)


_ROUND = "id string, ptr string, mn string, is_root boolean, is_target boolean, done string"


def _write_round(df: DataFrame) -> tuple[DataFrame, int]:
    """The written round, and how many of its nodes are still active (counted while they are written)."""
    spark, path, seen = df.sparkSession, scratch_path(df.sparkSession, "thread-round"), Observation()
    df.observe(seen, F.count_if(~F.col("done")).alias("active")).write.partitionBy("done").parquet(path)
    # the partition column is a folder name; a filter on it prunes folders
    rows = spark.read.schema(_ROUND).parquet(path).withColumn("done", F.col("done") == F.lit("true"))
    return rows, int(seen.get["active"])


def _resolved(rounds: list[DataFrame]) -> DataFrame:
    """Finished nodes of all rounds (about log2(depth) folders)."""
    out = rounds[0].where(F.col("done"))
    for rows in rounds[1:]:
        out = out.unionByName(rows.where(F.col("done")))
    return out


def thread_sizes(df: DataFrame, id_col: str, parent_col: str, last_wins_order: Sequence[str] = ()) -> DataFrame:
    """``df`` plus thread_id and thread_size (group size by a partial-aggregate count, no sort)."""
    roots = thread_roots(df, id_col, parent_col, last_wins_order)
    with_root = df.join(roots, F.col(id_col).cast("string") == roots["id"], "left").drop("id")
    sizes = with_root.groupBy("thread_id").agg(F.count(F.lit(1)).alias("thread_size"))
    return with_root.join(sizes, "thread_id")


def thread_features(df: DataFrame, id_col: str, parent_col: str, ts_col: str,
                    last_wins_order: Sequence[str] = ()) -> DataFrame:
    """``df`` plus thread_id, thread_step_index, is_thread_starter and thread_size."""
    roots = thread_roots(df, id_col, parent_col, last_wins_order)
    with_root = df.join(roots, F.col(id_col).cast("string") == roots["id"], "left").drop("id")
    pos = with_group_position(with_root, ["thread_id"], [F.col(ts_col).asc_nulls_last(), F.col(id_col)],
                              "thread_step_index", "thread_size")
    return (pos.withColumn("thread_step_index", F.col("thread_step_index").cast("int"))
            .withColumn("is_thread_starter", F.col("thread_step_index") == 0))


def previous_in_group(df: DataFrame, group: str, order: Sequence, cols: Sequence[str],
                      prefix: str = "prev_") -> DataFrame:
    """Columns of the previous row inside ``group`` by ``order`` (a distributed ``lag``).

    The predecessor in the global (group, order) order, kept only when it belongs to
    the same group (a hot group is split across range partitions like any other rows).
    """
    from postmetrics.operators.ordinal import with_previous
    prev = with_previous(df.withColumn("_pg0", F.col(group)),
                         [F.col(group), *[F.col(o) if isinstance(o, str) else o for o in order]],
                         ["_pg0", *cols], prefix)
    same = F.col(prefix + "_pg0").eqNullSafe(F.col(group))
    return prev.select(*[F.col(c) for c in df.columns],
                       *[F.when(same, F.col(prefix + c)).alias(prefix + c) for c in cols])
