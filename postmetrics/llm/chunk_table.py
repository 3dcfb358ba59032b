"""Distinct-chunk tables: encode each distinct chunk of text once, join ids back by position.

A tokenizer whose pieces never cross certain cuts gives the same ids for a text as for its chunks,
one after the other.  ``ChunkTable`` keeps the ids of the chunks it has met under their 64-bit hash
(with the byte length mixed in); each batch looks its chunks up, encodes only those that are new,
and gathers the ids of all occurrences by position with array operations.

The table of a worker holds at most ``most`` chunks and starts afresh beyond that, so memory is
bounded; this changes speed only, never a result.
"""

from __future__ import annotations

from typing import Callable

import numpy as np

from postmetrics.llm.textops import U64, grouping_order, prefix_sums, span_hash

#: (bytes, start and end of each chunk) -> (all ids one after the other, number of ids of each chunk)
Encoder = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class ChunkTable:
    def __init__(self, encode: Encoder, most: int = 1_500_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, U64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def _add(self, keys: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        ids, size = self.encode(buf, start, end)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.at = np.insert(self.at, where, at)
        self.size = np.insert(self.size, where, size.astype(np.int32))

    def ids_of(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in order, number of ids of each chunk) for the spans of ``buf``."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        keys = span_hash(prefix_sums(buf), start, end)
        order = grouping_order(keys)
        near = keys[order]
        first = np.concatenate(([True], near[1:] != near[:-1]))
        example = order[first]
        distinct = keys[example]
        by_key = np.argsort(distinct)
        distinct, example = distinct[by_key], example[by_key]
        if len(self.keys) + len(distinct) > self.most:
            self._clear()
        new = np.ones(len(distinct), bool)
        if len(self.keys):
            known = np.searchsorted(self.keys, distinct)
            known[known == len(self.keys)] = 0
            new = self.keys[known] != distinct
        if new.any():
            self._add(distinct[new], buf, start[example[new]], end[example[new]])
        found = np.empty(len(distinct), np.int64)
        found[by_key] = np.searchsorted(self.keys, distinct)
        entry = np.empty(len(keys), np.int64)
        entry[order] = found[np.cumsum(first) - 1]
        size = self.size[entry].astype(np.int64)
        return gather(self.ids, self.at[entry], size), size


def gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of ``buf`` one after the other."""
    first = np.cumsum(size) - size
    return buf[np.arange(int(size.sum())) + np.repeat(start - first, size)]


def per_row_counts(rows: np.ndarray, size: np.ndarray, n_rows: int) -> np.ndarray:
    """Number of ids of each row, from the number of ids of each chunk."""
    return np.bincount(rows, weights=size, minlength=n_rows).astype(np.int64) if len(rows) else np.zeros(n_rows, np.int64)
