"""SentencePiece encoding and decoding over a distinct-chunk table.

The model's pieces never hold a space marker after another character, so a text can be cut before
every run of spaces; a line break or tab that stands in no longer piece is a chunk by itself.  Each
distinct chunk is segmented once per worker table; the ids of a text are gathered by position.
Texts that hold the marker character itself, and all texts of a model for which these cuts are not
sound or that normalises its input, are encoded whole by the library.

Defined results: a null or empty text has no ids and decodes to an empty string; repeated rows give
repeated results; any further columns are passed over.  Texts may be of any length.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postmetrics.llm.chunk_table import ChunkTable, per_row_counts
from postmetrics.llm.textops import row_of, row_slices, text_buffer

#: Bytes of text handled at once in a task (a longer text is handled by itself).
STEP_BYTES = 2 << 20
MARK = "▁"
SPACE = 0x20
_BREAKS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D)


class Codec:
    """One worker's model with its chunk table."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
                  if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        joined = "".join(p for p in pieces if len(p) > 1)
        probe = "  Abé ﬁ\t Ώ\n x "
        self.by_chunk = (not any(MARK in p.lstrip(MARK) or " " in p for p in pieces) and "\n" not in joined
                         and model.normalize(probe) == MARK + probe.replace(" ", MARK))
        self.alone = np.zeros(256, bool)
        self.alone[[b for b in _BREAKS if chr(b) not in joined]] = True
        one, two = model.encode("\n"), model.encode("\n\n")
        self.break_ids = len(one)
        self.mark = one[:2 * len(one) - len(two)]
        self.table = ChunkTable(self._encode_chunks)

    def _encode_chunks(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = buf.tobytes()
        chunks = [raw[s:e] for s, e in zip(start.tolist(), end.tolist())]
        # The library puts one marker before what it encodes.  It stands for the first space of a
        # chunk; before a chunk without a space a line break goes first and its ids go again.
        texts = [c[1:].decode() if c[0] == SPACE else "\n" + c.decode() for c in chunks]
        ids = [i if c[0] == SPACE else i[self.break_ids:]
               for c, i in zip(chunks, self._encode_marked(texts))]
        size = np.array([len(i) for i in ids], np.int64)
        return np.array([x for i in ids for x in i], np.int32), size

    def _encode_marked(self, texts: list) -> list:
        # a chunk of one space leaves an empty text, for which the library gives no ids
        return [i if t else self.mark for t, i in zip(texts, self.model.encode(texts, num_threads=1))]

    def encode(self, texts: pa.Array):
        """Yield (row range, ids of its rows one after the other, number of ids of each row)."""
        buf, starts, ends = text_buffer(texts)
        for lo, hi in row_slices(starts, ends, STEP_BYTES):
            part, s, e = buf[starts[lo]:ends[hi - 1]], starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo]
            if not self.by_chunk or part.tobytes().find(MARK.encode()) >= 0:
                ids = [self.model.encode(part[a:z].tobytes().decode()) for a, z in zip(s, e)]
                yield (lo, hi), np.array([x for i in ids for x in i], np.int32), np.array([len(i) for i in ids], np.int64)
                continue
            # one space before each text that is not empty: the marker the library puts first
            full = s < e
            lengths = (e - s) + full
            ends2 = np.cumsum(lengths)
            starts2 = ends2 - lengths
            padded = np.full(int(lengths.sum()), SPACE, np.uint8)
            inside = np.ones(len(padded), bool)
            inside[starts2[full]] = False
            padded[inside] = part
            space = padded == SPACE
            first = self.alone[padded]
            first[1:] |= self.alone[padded[:-1]]
            first[1:] |= space[1:] & ~space[:-1]
            first[starts2[full]] = True
            start = np.flatnonzero(first)
            ids, size = self.table.ids_of(padded, start, np.append(start[1:], len(padded)))
            yield (lo, hi), ids, per_row_counts(row_of(starts2, start), size, hi - lo)

    def decode(self, ids: list) -> str:
        return self.model.decode(ids)


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id column, ``ids`` array<int>: the ids of every whole text."""
    def run(batches):
        c = codec(model_file)
        for b in batches:
            keys = b.column(0)
            for (lo, hi), ids, size in c.encode(b.column(1)):
                offsets = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))],
                                                 names=["id", "ids"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id") -> DataFrame:
    """id column, ``text``: the library's decode(ids) of every row of ``ids``; null ids give an empty text."""
    def run(batches):
        c = codec(model_file)
        for b in batches:
            texts = [c.decode(i or []) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])
    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id column, n_tokens, ids_sha256, decoded_sha256 of every whole text, in one pass over it."""
    def run(batches):
        c = codec(model_file)
        decimal = [str(i) for i in range(c.model.get_piece_size())]
        for b in batches:
            keys = b.column(0)
            for (lo, hi), ids, size in c.encode(b.column(1)):
                ids_hash, text_hash, at = [], [], 0
                for n in size.tolist():
                    own = ids[at:at + n].tolist()
                    at += n
                    ids_hash.append(hashlib.sha256(",".join([decimal[i] for i in own]).encode()).hexdigest())
                    text_hash.append(hashlib.sha256(c.decode(own).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(ids_hash), pa.array(text_hash)],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
