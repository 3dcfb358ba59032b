"""Packing token sequences by best-fit decreasing.

A document (its ids and one end id) longer than a window is first cut into full windows; what is
left over is placed, longest first, into the open window with the least room that still holds it.
A segment tree over the remaining capacities finds that window.  Left-overs are dealt into groups of
about ``group_pieces`` pieces by the hash of their row number in the staged table of pieces, so no
group grows with the input, and each group packs on its own.

Defined results: a null or empty text is one piece, its end id; null ids and repeated rows are packed
like any other row; an empty table gives no pieces; other columns are ignored.  A window is padded
to its full size, except one whose tokens number a power of two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmetrics.llm.byte_pieces import encoder
from postmetrics.llm.staging import stage

WINDOW = 1024
GROUP_PIECES = 4096


class CapacityTree:
    """Open windows by remaining capacity; a segment tree over capacities 0..most holds their number."""

    def __init__(self, most: int):
        self.leaf = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaf)
        self.open: list[list] = [[] for _ in range(self.leaf)]

    def put(self, capacity: int, window) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaf
        while i:
            self.count[i] += by
            i >>= 1

    def take_tightest(self, least: int):
        """(capacity, window) with the smallest capacity of at least ``least``, or None."""
        i, count = least + self.leaf, self.count
        if not count[i]:
            while True:
                if i <= 1:
                    return None
                if not i & 1 and count[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.leaf:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaf
        window = self.open[capacity].pop()
        self._add(capacity, -1)
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset in it) of each piece."""
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = CapacityTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if n == window:
            number[i], opened = opened, opened + 1
            continue
        found = tree.take_tightest(n)
        if found is None:
            found, opened = (window, opened), opened + 1
        capacity, at = found
        number[i], offset[i] = at, window - capacity
        if capacity > n:
            tree.put(capacity - n, at)
    return number, offset


def cut_pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = 0, keep_ids: bool = False,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: id, start, length, ids_crc32, doc_tokens (and ``ids`` if kept)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            for (lo, hi), ids, size in enc.encode(b.column(1)):
                rows, start, length, crc, total, kept, at = [], [], [], [], [], [], 0
                for r, n in zip(range(lo, hi), size.tolist()):
                    own = np.append(ids[at:at + n], end_id).astype("<u4")
                    at += n
                    for a in range(0, n + 1, window):
                        piece = own[a:a + window]
                        rows.append(r)
                        start.append(a)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(n + 1)
                        if keep_ids:
                            kept.append(piece.astype(np.int32))
                columns = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                           pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    ddl = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if keep_ids else "")
    return docs.select(id_col, text_col).mapInArrow(run, ddl).withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (staged, with ``length``) plus sequence_id and offset."""
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        number, offset = best_fit_decreasing(group["length"].to_numpy(), window)
        out = group.drop(columns="pack_group")
        out["sequence_id"] = (group["pack_group"].to_numpy().astype(np.int64) << 32) + number
        out["offset"] = offset
        return out

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("pack_group").applyInPandas(run, ddl)


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, keep_ids: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with their place: sequence_id and offset."""
    return pack(stage(cut_pieces(docs, vocabulary, window, 0, keep_ids, id_col, text_col), "pieces"), window)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids: the windows themselves, from pieces packed with their ids."""
    whole = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    missing = F.when(power, 0).otherwise(F.lit(window) - F.col("n_tokens")).cast("int")
    return whole.select("sequence_id", "n_tokens", F.concat(ids, F.array_repeat(F.lit(pad_id), missing)).alias("ids"))
