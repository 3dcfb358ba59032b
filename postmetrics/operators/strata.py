"""Engagement strata and seeded samples (labelling workflow).

Strata are slices of the value-descending order at floor bounds
(n//4, n//2, 3n//4) - not ``ntile``, which fills the first buckets when
n % 4 != 0.  Positions come from the distributed ordinal, so no task holds
the whole frame; samples order each stratum by a seeded hash and keep the
first k, again by distributed positions (a stratum may be a third of all rows).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmetrics.operators.ordinal import SKETCH_ACCURACY, select_rows, sketch_edges, with_global_index, with_group_position


def quartile_strata(df: DataFrame, value: str, tiebreak: str, name: str = "stratum") -> DataFrame:
    """Stratum 1 (top quarter) .. 4 (bottom) by floor bounds of the descending order."""
    return _strata(df, value, tiebreak, [(1, 4), (1, 2), (3, 4)], name)


def three_strata(df: DataFrame, value: str, tiebreak: str, name: str = "stratum") -> DataFrame:
    """high / mid / low = [0, n//4), [n//4, 3n//4), [3n//4, n)."""
    out = _strata(df, value, tiebreak, [(1, 4), (3, 4)], "_s")
    return out.withColumn(name, F.element_at(F.array(F.lit("high"), F.lit("mid"), F.lit("low")), F.col("_s"))).drop("_s")


def _strata(df, value, tiebreak, fractions, name):
    """Stratum = 1 + number of floor bounds at or before the row's rank in the
    (value desc, tiebreak asc) order.  The bound rows are selected exactly without
    sorting the table (``select_rows``); the sort-based positions are the fallback."""
    key = F.coalesce(-F.col(value).cast("double"), F.lit(float("inf")))   # value desc, NULL last
    keyed = df.withColumn("_sk", key)
    edges = sketch_edges([a / b for a, b in fractions])
    seen = keyed.agg(F.count("*").alias("n"), F.percentile_approx("_sk", edges, SKETCH_ACCURACY).alias("e")).first()
    n = seen["n"]
    bounds = [int(n * a // b) for a, b in fractions]
    sketch = dict(zip(edges, seen["e"])) if n else None
    picked = select_rows(keyed.select("_sk", tiebreak), "_sk", tiebreak, bounds, n=n, sketch=sketch) if n else []
    if picked is None:
        idx = with_global_index(df, [F.col(value).desc_nulls_last(), F.col(tiebreak).asc()], "_r")
        s = F.lit(1)
        for b in bounds:
            s = s + F.when(F.col("_r") >= F.lit(b), 1).otherwise(0)
        return idx.withColumn(name, s.cast("int")).drop("_r")
    s = F.lit(1)
    for kb, ib in picked:
        at_or_after = (F.col("_sk") > F.lit(kb)) | ((F.col("_sk") == F.lit(kb)) & (F.col(tiebreak) >= F.lit(ib)))
        s = s + F.when(at_or_after, 1).otherwise(0)
    return keyed.withColumn(name, s.cast("int")).drop("_sk")


#: Hex digits of the md5 order key that the candidate threshold looks at.
KEY_DIGITS = 13


def seeded_key(id_col: str, seed: int = 42) -> Column:
    """Deterministic pseudo-random order key: md5 of ``id:seed``, for ids of any type."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def _share(key: Column) -> Column:
    """The key's place in [0, 1): its leading digits as a fraction."""
    return F.conv(F.substring(key, 1, KEY_DIGITS), 16, 10).cast("double") / F.lit(float(16 ** KEY_DIGITS))


def _quota(per_stratum, stratum: str) -> Column:
    if isinstance(per_stratum, dict):
        pairs = [x for kv in per_stratum.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]
        return F.coalesce(F.element_at(F.create_map(*pairs), F.col(stratum)), F.lit(0))
    return F.lit(per_stratum)


def stratified_sample(df: DataFrame, stratum: str, id_col: str, per_stratum: int | dict,
                      seed: int = 42, name: str = "_pos", oversample: float = 4.0) -> DataFrame:
    """At most k rows per stratum, without replacement: the k smallest (seeded key, id).

    Exact, in one scan: every task keeps its k first rows of a stratum before anything moves, those of
    some tasks are merged under a salt, and then those of a stratum; so no task sees more than k
    rows of each of a bounded number of others.  Spark cuts groups that way up to a limit of
    ``TASK_LIMIT`` rows; for larger k ``_thresholded`` finds the same rows.
    """
    keyed = df.withColumn("_key", seeded_key(id_col, seed))
    most = max(per_stratum.values(), default=0) if isinstance(per_stratum, dict) else per_stratum
    if most >= TASK_LIMIT:
        return _thresholded(keyed, stratum, id_col, per_stratum, name, oversample)
    salted = keyed.withColumn("_salt", F.spark_partition_id() % F.lit(SALTS))
    for groups in ([stratum, "_salt"], [stratum]):
        place = F.row_number().over(Window.partitionBy(*groups).orderBy("_key", id_col))
        salted = salted.withColumn(name, place).where(F.col(name) <= most)
    pos = salted.withColumn(name, (F.col(name) - 1).cast("long"))
    return pos.where(F.col(name) < _quota(per_stratum, stratum)).drop("_key", "_salt")


#: Largest k that tasks cut groups at (Spark's own limit for it), and salts of the first merge.
TASK_LIMIT, SALTS = 1000, 256


def _thresholded(keyed: DataFrame, stratum: str, id_col: str, per_stratum: int | dict, name: str, oversample: float) -> DataFrame:
    """The sample for large k.  Hash keys are uniform, so a per-stratum share sized for
    ~``oversample`` x k rows keeps a small candidate set; a partial-aggregate check proves each
    stratum kept at least min(k, n) rows (otherwise the share widens and the check repeats), and
    only the candidates are ranked.
    """
    sizes = keyed.groupBy(stratum).agg(F.count(F.lit(1)).alias("_ns")).withColumn("_q", _quota(per_stratum, stratum))
    factor = oversample
    while True:
        want = F.lit(factor) * F.col("_q") + F.lit(32)
        th = sizes.select(stratum, "_ns", "_q", F.least(F.lit(1.0), want / F.col("_ns")).alias("_t"))
        cand = keyed.join(th.select(stratum, "_t"), stratum).where(_share(F.col("_key")) <= F.col("_t")).drop("_t")
        got = cand.groupBy(stratum).agg(F.count(F.lit(1)).alias("_nc"))
        short = (th.join(got, stratum, "left")
                 .where((F.coalesce(F.col("_nc"), F.lit(0)) < F.least(F.col("_q"), F.col("_ns")))
                        & (F.col("_t") < F.lit(1.0))))
        if short.limit(1).count() == 0:
            break
        factor *= 8
    pos = with_group_position(cand, [stratum], ["_key", id_col], name, None)
    return pos.where(F.col(name) < _quota(per_stratum, stratum)).drop("_key")


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``drop_duplicates(subset=keys)`` with a defined winner: smallest ``order`` tuple.

    A partial aggregate of ``min(struct(order, rest))`` - O(1) state per key,
    no window, so a key with a third of the rows is combined map-side.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])).alias("_w")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col("_w")[c].alias(c) for c in [*order, *rest]])
