"""Byte-level BPE ids of whole texts over a distinct-chunk table.

The vocabulary file (tokenizers JSON, byte-level BPE with the usual word pattern) splits a text into
words, runs of white space and so on before merging.  Cuts that this split always makes are found by
array operations: before a run of white space, after one that does not end in a space, and before
the last white space of a longer run that a word follows.  Chunks between such cuts are encoded
once; ids are gathered by position.  Texts with white space outside ASCII or with an added token of
the vocabulary (matched before any split) are encoded whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from postmetrics.llm.chunk_table import ChunkTable, gather, per_row_counts
from postmetrics.llm.textops import SPACES, row_of, row_slices, text_buffer

STEP_BYTES = 2 << 20
SPACE = 0x20
#: UTF-8 of white space outside ASCII (fixed values of Unicode)
_OTHER_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def _byte_of_char() -> dict:
    """The printable stand-ins byte-level vocabularies use, back to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(sorted(set(range(256)) - set(plain))):
        out[chr(256 + k)] = b
    return out


class Encoder:
    """One worker's vocabulary with its chunk table."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        spec = json.load(open(vocabulary, encoding="utf-8"))
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.only_whole = re.compile(b"|".join([_OTHER_SPACE.pattern, *(re.escape(t.encode()) for t in sorted(special))]))
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.merges = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.length[i] = len(piece)
        self.break_id = ranks[b"\n"]
        self.table = ChunkTable(self._encode_chunks)

    def _encode_chunks(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Words go through the library as one text, each after its own space or after a line break
        # that is taken out again; the split restarts at each of them.
        size = np.zeros(len(start), np.int64)
        word = ~SPACES[buf[end - 1]]
        s, n = start[word], (end - start)[word]
        bare = buf[s] != SPACE
        text = np.full(int((n + bare).sum()), 0x0A, np.uint8)
        to = np.cumsum(n + bare)
        inside = np.ones(len(text), bool)
        inside[(to - n - bare)[bare]] = False
        text[inside] = gather(buf, s, n)
        ids = self.merges.encode_to_numpy(text.tobytes().decode(), disallowed_special=()).astype(np.int32)
        last = np.searchsorted(np.cumsum(self.length[ids]), to, side="left") + 1
        first = np.concatenate(([0], last[:-1])).astype(np.int64)
        keep = np.ones(len(ids), bool)
        keep[first[bare]] = False
        size[word] = last - first - bare
        runs = np.flatnonzero(~word)
        if not len(runs):
            return ids[keep], size
        # runs of white space, a few kinds only, one by one
        own = [np.array(self.merges.encode_ordinary(buf[a:z].tobytes().decode()), np.int32)
               for a, z in zip(start[runs].tolist(), end[runs].tolist())]
        size[runs] = [len(x) for x in own]
        out = np.empty(int(size.sum()), np.int32)
        of_run = np.repeat(~word, size)
        out[~of_run], out[of_run] = ids[keep], np.concatenate(own)
        return out, size

    def encode(self, texts: pa.Array):
        """Yield (row range, ids of its rows one after the other, number of ids of each row)."""
        buf, starts, ends = text_buffer(texts)
        for lo, hi in row_slices(starts, ends, STEP_BYTES):
            part, s, e = buf[starts[lo]:ends[hi - 1]], starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo]
            if self.only_whole.search(part.tobytes()):
                out = [self.whole.encode(part[a:z].tobytes().decode(), add_special_tokens=False).ids for a, z in zip(s, e)]
                yield (lo, hi), np.array([x for i in out for x in i], np.int32), np.array([len(i) for i in out], np.int64)
                continue
            start = self._cuts(part, s, e)
            ids, size = self.table.ids_of(part, start, np.append(start[1:], len(part)))
            yield (lo, hi), ids, per_row_counts(row_of(s, start), size, hi - lo)

    @staticmethod
    def _cuts(part: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        white = SPACES[part]
        before = np.zeros(len(part), bool)
        before[1:] = white[:-1]
        after_space = np.zeros(len(part), bool)
        after_space[1:] = part[:-1] == SPACE
        word_next = np.zeros(len(part), bool)
        word_next[:-1] = ~white[1:]
        word_next[e[s < e] - 1] = False
        first = np.where(white, ~before | word_next, before & ~after_space)
        first[s[s < e]] = True
        # at the first byte of a row nothing stands before: its white space is a run of its own
        return np.flatnonzero(first)


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)
