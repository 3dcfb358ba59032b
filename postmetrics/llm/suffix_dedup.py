"""Removal of long repeated byte strings by sampled suffixes and refined names.

Wanted: every byte covered by a ``length``-byte string that also starts anywhere else.  Ranking all
suffixes of a corpus takes several times its size in sort records, so only a sample of them is named
and the others are placed by their distance to it:

* Sample.  Among the tuples (``TUPLE`` bytes) inside a window of ``length`` bytes the one with the
  smallest hash, the last on ties, is the window's sample position.  Equal windows have it at the
  same offset, wherever they stand, which is the property of a difference cover; a window belongs
  to one sample position, and those of one position start at consecutive bytes.
* Names.  Windows of one sample position are taken in blocks of ``BLOCK`` offsets.  A block has two
  names, hashes of the bytes common to all its windows (core) and of all bytes they span (wide).
  Equal names meet in one sort and aggregation.  A core that stands alone settles the block: none of
  its windows repeats.  A wide name that repeats settles it too: all of them do.
* Recursion.  Only blocks left open, near the ends of repeated runs, are named once more, window by
  window, together with one representative of every settled block of the same core.

Every step is an aggregation or join of fixed-size rows by name; no group of equal strings is ever
held by one task.  Names are pairs of hashes (core, and wide or window), each of two polynomials modulo a
prime; they share these polynomials.

Defined results: null texts are empty; texts shorter than ``length`` keep all bytes; repeated rows are
documents of their own, so they remove each other; ids may be null or shared; an empty table gives
no rows.  In the kept text, characters that lost some of their bytes are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmetrics.llm.staging import drop, release_shuffles, stage
from postmetrics.llm.textops import U64, mix, prefix_sums, row_slices, span_hash, span_rank, text_buffer

LENGTH = 400
TUPLE = 100
BLOCK = 64
STEP_BYTES = 1 << 19
#: Windows of one text ranked at a time.
PART = 1 << 20
_PLACE_BITS = U64(28)
_PLACES = U64((1 << 28) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values (two running minima over blocks of that width)."""
    n = len(x)
    padded = np.full(-(-n // width) * width, U64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = x
    folded = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(folded, axis=1).ravel()
    back = np.minimum.accumulate(folded[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(back[:m], ahead[width - 1:width - 1 + m])


def sample_positions(sums: np.ndarray, start: int, end: int, length: int) -> np.ndarray:
    """Offset (from ``start``) of the sample position of every window of the row [start, end)."""
    tuple_bytes = min(TUPLE, length)
    width = length - tuple_bytes + 1
    windows = end - start - length + 1
    out = np.empty(windows, np.int64)
    for lo in range(0, windows, PART):
        n = min(PART, windows - lo)
        at = np.arange(lo, lo + n + width - 1)
        # the rank's upper bits, then the place in the part counted backwards: a smaller value is later on ties
        ranked = (span_rank(sums, start + at, start + at + tuple_bytes) >> _PLACE_BITS << _PLACE_BITS) | (_PLACES - (at - lo).astype(U64))
        out[lo:lo + n] = lo + (_PLACES - (_sliding_min(ranked, width) & _PLACES)).astype(np.int64)
    return out


def _blocks_of(sums: np.ndarray, start: int, end: int, length: int):
    """(sample, block, first, last window start, core, wide, wide exists) of the blocks of one row."""
    sample = sample_positions(sums, start, end, length)
    block = (sample - np.arange(len(sample))) // BLOCK
    key = sample * 1024 + block
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    last = np.append(first[1:], len(sample)) - 1
    p, k = sample[first], block[first]
    # equal windows stand at equal offsets, so a block's number is part of its names
    number = mix(k.astype(U64))
    core = span_hash(sums, start + p - k * BLOCK, start + p + length - (k * BLOCK + BLOCK - 1)) ^ number
    lo, hi = p - k * BLOCK - (BLOCK - 1), p + length - k * BLOCK
    inside = (lo >= 0) & (hi <= end - start)
    wide = np.zeros(len(p), U64)
    wide[inside] = span_hash(sums, start + lo[inside], start + hi[inside]) ^ number[inside]
    return first, last, core, wide, inside


def _named_blocks(docs: DataFrame, length: int, kind: str) -> DataFrame:
    def run(batches):
        for b in batches:
            buf, starts, ends = text_buffer(b.column(2))
            for lo, hi in row_slices(starts, ends, STEP_BYTES):
                base = starts[lo]
                if ends[hi - 1] - base < length:
                    continue
                sums = prefix_sums(buf[base:ends[hi - 1]])
                rows, found = [], []
                for r in range(lo, hi):
                    if ends[r] - starts[r] >= length:
                        found.append(_blocks_of(sums, int(starts[r] - base), int(ends[r] - base), length))
                        rows.append(np.full(len(found[-1][0]), r))
                if not rows:
                    continue
                first, last, core, wide, inside = (np.concatenate(c) for c in zip(*found))
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                     pa.array(core.view(np.int64)), pa.array(wide.view(np.int64), mask=~inside)],
                    names=["id", "own", "first", "last", "core", "wide"])
    return docs.mapInArrow(run, f"id {kind}, own long, first int, last int, core long, wide long")


def _window_names(rows: DataFrame, length: int, kind: str) -> DataFrame:
    """One row for each window of the listed blocks: id, own, core, start, name, open."""
    def run(batches):
        for b in batches:
            buf, starts, ends = text_buffer(b.column(2))
            blocks = b.column(3)
            bound = np.asarray(blocks.offsets)
            flat = blocks.values
            first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
            core, open_ = flat.field("core").to_numpy(), flat.field("open").to_numpy(zero_copy_only=False)
            for r in range(b.num_rows):
                if bound[r] == bound[r + 1]:
                    continue
                sums = prefix_sums(buf[starts[r]:ends[r]])
                own = slice(bound[r], bound[r + 1])
                size = (last[own] - first[own] + 1).astype(np.int64)
                at = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                take = pa.array(np.full(len(at), r))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(np.repeat(core[own], size)), pa.array(at.astype(np.int32)),
                     pa.array(span_hash(sums, at, at + length).view(np.int64)), pa.array(np.repeat(open_[own], size))],
                    names=["id", "own", "core", "start", "name", "open"])
    return rows.mapInArrow(run, f"id {kind}, own long, core long, start int, name long, open boolean")


def repeated_windows(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, own (text hash), spans array<struct<first, last>>: starts of repeated windows (staged)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("text"))
    blocks = stage(_named_blocks(texts, length, kind), "named_blocks")
    cores = stage(blocks.groupBy("core").count().where("count > 1").select("core"), "repeated_cores")
    release_shuffles(spark)
    again = stage(blocks.join(cores, "core", "left_semi"), "repeated_blocks")
    drop(blocks, cores)
    release_shuffles(spark)
    wides = stage(again.where("wide IS NOT NULL").groupBy("core", "wide").count().where("count > 1").select(
        "core", "wide", F.lit(True).alias("settled")), "repeated_wides")
    judged = stage(again.join(wides, ["core", "wide"], "left").withColumn("settled", F.coalesce("settled", F.lit(False))), "judged_blocks")
    drop(again, wides)
    release_shuffles(spark)

    left = judged.where(~F.col("settled"))
    open_cores = stage(left.select("core").distinct(), "open_cores")
    stand_in = (judged.where("settled").join(open_cores, "core", "left_semi").groupBy("core", "wide")
                .agg(F.min(F.struct("id", "own", "first", "last")).alias("one")).select("one.*", "core", F.lit(False).alias("open")))
    listed = left.select("id", "own", "first", "last", "core", F.lit(True).alias("open")).unionByName(stand_in)
    per_text = listed.groupBy("id", "own").agg(F.collect_list(F.struct("first", "last", "core", "open")).alias("blocks"))
    per_text = stage(per_text, "open_blocks")
    with_text = texts.join(per_text, texts["id"].eqNullSafe(per_text["id"]) & (texts["own"] == per_text["own"])).select(
        texts["id"], texts["own"], "text", "blocks")
    windows = stage(_window_names(with_text, length, kind), "window_names")
    release_shuffles(spark)
    twice = windows.groupBy("core", "name").count().where("count > 1").select("core", "name")
    found = windows.where("open").join(twice, ["core", "name"], "left_semi").select(
        "id", "own", F.col("start").alias("first"), F.col("start").alias("last"))
    every = judged.where("settled").select("id", "own", "first", "last").unionByName(found)
    spans = stage(every.groupBy("id", "own").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "repeated_windows")
    drop(judged, open_cores, per_text, windows)
    release_shuffles(spark)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   keep: list | None = None) -> DataFrame:
    """The id, or a struct ``row`` of the columns ``keep``; kept_text, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spans = repeated_windows(docs, length, id_col, text_col)

    def run(batches):
        for b in batches:
            buf, starts, ends = text_buffer(b.column(0))
            listed = b.column(1)
            bound = np.asarray(listed.offsets)
            first, last = listed.values.field("first").to_numpy(), listed.values.field("last").to_numpy()
            valid = listed.is_valid().to_numpy(zero_copy_only=False)
            texts, removed, runs, digests = [], [], [], []
            for r in range(b.num_rows):
                raw = buf[starts[r]:ends[r]]
                if valid[r]:
                    step = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(step, first[bound[r]:bound[r + 1]], 1)
                    np.add.at(step, last[bound[r]:bound[r + 1]] + length, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    removed.append(int(gone.sum()))
                    runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                    kept = raw[~gone].tobytes()
                else:
                    removed.append(0)
                    runs.append(0)
                    kept = raw.tobytes()
                texts.append(kept.decode("utf-8", "ignore"))
                digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[2:], pa.array(texts, pa.string()), pa.array(ends - starts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(runs, pa.int64()), pa.array(digests, pa.string())],
                names=[*b.schema.names[2:], "kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    first = F.struct(*keep).alias("row") if keep else F.col(id_col).alias("row")
    texts = docs.select(first, F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_text"), F.col(text_col).alias("text"))
    joined = texts.join(spans, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_text") == F.col("own")), "left").select("text", "spans", "row")
    out = joined.mapInArrow(run, f"row {joined.schema['row'].dataType.simpleString()}, kept_text string, n_bytes long, n_removed long, "
                                 "n_spans long, kept_sha256 string")
    return out if keep else out.withColumnRenamed("row", id_col)
