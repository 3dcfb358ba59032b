"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is its lower-cased words joined by one space and closed by an end byte.  Every byte is a path
of binary decisions, in the Huffman tree of the training bytes; for each decision a tree over the preceding bytes holds, at depths 0 to ``DEPTH``,
the counts of zeros and ones and their Krichevsky-Trofimov estimate.  A node's weighted block
probability is half its own estimate's and half the product of its children's; the share that falls
to its own estimate is the weight with which that depth enters a prediction.  Contexts never met in
training end the path at the last one that was.

The model lives in Spark tables, keyed by (context, next byte):

* ``grams``: distinct contexts with next byte in each block of documents, with training counts; a
  block is a bounded share of the documents, chosen by hash.
* counts are summed over blocks by aggregation; buckets of contexts that share their last three bytes
  build the deep levels of the tree; two further aggregations give the shallow ones (depths 0 and 1
  have at most 65,535 nodes and go to the driver).
* each bucket then predicts its contexts, and a join by (context, next byte) brings the code lengths
  to the blocks, where they are summed over whole texts.

The unigram baseline (words and end, add-half smoothing) takes the same route with word hashes.

Defined results: a null or empty text is the end alone; repeated rows are counted and scored like any
other; rows with a null condition do not train; without training texts every bit has probability
one half; an empty table gives no rows; columns not asked for are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmetrics.llm.staging import drop, release_shuffles, stage
from postmetrics.llm.textops import LOWER, U64, prefix_sums, row_slices, sorted_distinct, span_hash, text_buffer, word_spans

DEPTH = 5
SHARED = 3
BLOCK_BYTES = 32 << 20
BUCKET_GRAMS = 200_000
STEP_BYTES = 1 << 20
SPACE, END = 0x20, 0x0A
_WORD = U64(1) << U64(63)
_HALF = math.log(0.5)


# -- texts ---------------------------------------------------------------------------------------

def _canonical(part: np.ndarray, s: np.ndarray, e: np.ndarray):
    """(bytes, row of each byte, start of each row) of the canonical texts; (word hash, row of each word)."""
    low = LOWER[part]
    ws, we, wr = word_spans(low, s, e)
    size = we - ws + 1
    per_row = np.bincount(wr, weights=size, minlength=len(s)).astype(np.int64) if len(ws) else np.zeros(len(s), np.int64)
    per_row[per_row == 0] = 1
    start = np.cumsum(per_row) - per_row
    out = np.full(int(per_row.sum()), SPACE, np.uint8)
    if len(ws):
        # words follow each other; a text without words is its end alone and shifts the rest by one
        gaps = np.cumsum(np.bincount(wr, minlength=len(s)) == 0)
        to = np.cumsum(size) - size + gaps[wr]
        n = we - ws
        first = np.cumsum(n) - n
        along = np.arange(int(n.sum()))
        out[along + np.repeat(to - first, n)] = low[along + np.repeat(ws - first, n)]
    out[start + per_row - 1] = END
    words = (span_hash(prefix_sums(low), ws, we) | _WORD) if len(ws) else np.zeros(0, U64)
    return out, np.repeat(np.arange(len(s)), per_row), start, words, wr


def _grams(text: np.ndarray, start: np.ndarray, row: np.ndarray, depth: int) -> np.ndarray:
    """Context (latest byte first) and next byte of every position; before a text stand end bytes."""
    into = np.arange(len(text)) - start[row]
    code = text.astype(U64)
    for d in range(1, depth + 1):
        past = np.full(len(text), END, np.uint8)
        past[d:] = text[:-d] if d < len(text) else text[:0]
        past[into < d] = END
        code |= past.astype(U64) << U64(8 * (depth - d + 1))
    return code


def _steps(table: pa.Table, column: str):
    """Steps of a block of documents: (rows, canonical text, ...)."""
    buf, starts, ends = text_buffer(table.column(column))
    for lo, hi in row_slices(starts, ends, STEP_BYTES):
        base = starts[lo]
        yield slice(lo, hi), _canonical(buf[base:ends[hi - 1]], starts[lo:hi] - base, ends[lo:hi] - base)


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several sorted (keys, counts), with their summed counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at)


# -- the tree ------------------------------------------------------------------------------------

def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: Stirling's series after a shift by eight."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        shift += np.log(y)
        y = y + 1
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log block probability of the Krichevsky-Trofimov estimator."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - math.log(math.pi)


class Decomposition:
    """A byte as binary decisions: its path in the Huffman tree of the training bytes.

    Leaves are numbered from left to right, so the leaves below a node are adjacent; ``node`` and
    ``bit`` give, for every leaf, the decision node (0 to 254) and its outcome at each step.
    """

    def __init__(self, frequency: np.ndarray):
        heap = [(int(n) + 1, b, (b,)) for b, n in enumerate(frequency)]
        heapq.heapify(heap)
        serial = 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], serial, (a[2], b[2])))
            serial += 1
        paths: dict[int, list] = {}
        todo, number, order = [(heap[0][2], [])], 0, []
        while todo:
            tree, path = todo.pop()
            if len(tree) == 1:
                paths[tree[0]] = path
                order.append(tree[0])
                continue
            todo += [(tree[1], [*path, (number, 1)]), (tree[0], [*path, (number, 0)])]
            number += 1
        self.leaf = np.zeros(256, U64)
        self.leaf[order] = np.arange(256, dtype=U64)
        self.steps = np.array([len(paths[b]) for b in order])
        self.node = np.zeros((256, self.steps.max()), U64)
        self.bit = np.zeros((256, self.steps.max()), bool)
        for k, b in enumerate(order):
            for j, (node, bit) in enumerate(paths[b]):
                self.node[k, j], self.bit[k, j] = node, bool(bit)

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """Codes with the next byte replaced by its leaf."""
        return (codes & ~U64(255)) | self.leaf[(codes & U64(255)).astype(np.int64)]


class Level:
    """Nodes of one depth: key (context << 8 | decision node), counts, weights."""

    def __init__(self, keys, zeros, ones):
        order = np.argsort(keys)
        self.keys, self.zeros, self.ones = keys[order], zeros[order].astype(np.float64), ones[order].astype(np.float64)
        self.log_weighted = self.stop = None

    def weigh(self, children_log: np.ndarray | None) -> None:
        own = _log_kt(self.zeros, self.ones)
        if children_log is None:
            self.log_weighted, self.stop = own, np.ones(len(own))
            return
        self.log_weighted = np.logaddexp(_HALF + own, _HALF + children_log)
        self.stop = np.exp(np.minimum(_HALF + own - self.log_weighted, 0))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == keys

    def sum_children(self, deeper: "Level") -> np.ndarray:
        at, _ = self.find(_parent(deeper.keys))
        return np.bincount(at, weights=deeper.log_weighted, minlength=len(self.keys))


def _parent(keys: np.ndarray) -> np.ndarray:
    return ((keys >> U64(16)) << U64(8)) | (keys & U64(255))


def _level(codes: np.ndarray, counts: np.ndarray, way: Decomposition) -> Level:
    """Nodes of the distinct, sorted codes (context << 8 | leaf)."""
    keys, zeros, ones = [], [], []
    leaf = (codes & U64(255)).astype(np.int64)
    for j in range(way.node.shape[1]):
        on = way.steps[leaf] > j
        codes, counts, leaf = codes[on], counts[on], leaf[on]
        if not len(codes):
            break
        key = (codes & ~U64(255)) | way.node[leaf, j]
        bit = way.bit[leaf, j]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        keys.append(key[at])
        ones.append(np.add.reduceat(counts * bit, at))
        zeros.append(np.add.reduceat(counts * ~bit, at))
    if not keys:
        none = np.zeros(0, np.int64)
        return Level(np.zeros(0, U64), none, none)
    return Level(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))


def _shorten(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes with the oldest context byte gone, distinct, counts summed."""
    return _merge([(((codes >> U64(16)) << U64(8)) | (codes & U64(255)), counts)]) if len(codes) else (codes, counts)


def deep_levels(codes: np.ndarray, counts: np.ndarray, depth: int, way: Decomposition) -> dict[int, Level]:
    """Levels SHARED..depth of the contexts of one bucket, weighted from the deepest up."""
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    seen = counts > 0
    codes, counts = codes[seen], counts[seen]
    levels = {}
    for d in range(depth, SHARED - 1, -1):
        levels[d] = _level(codes, counts, way)
        levels[d].weigh(levels[d].sum_children(levels[d + 1]) if d < depth else None)
        codes, counts = _shorten(codes, counts)
    return levels


def code_lengths(codes: np.ndarray, levels: dict[int, Level], depth: int, way: Decomposition) -> np.ndarray:
    """log10 probability of the next byte of every code (context << 8 | leaf)."""
    total = np.zeros(len(codes))
    leaf = (codes & U64(255)).astype(np.int64)
    for j in range(way.node.shape[1]):
        on = np.flatnonzero(way.steps[leaf] > j)
        if not len(on):
            break
        node, bit, context = way.node[leaf[on], j], way.bit[leaf[on], j], codes[on] >> U64(8)
        mixed, rest = np.zeros(len(on)), np.ones(len(on))
        here, seen = levels[0].find(node)
        mixed[~seen], rest[~seen] = 0.5, 0.0
        for d in range(depth + 1):
            level = levels[d]
            if not len(level.keys):
                break
            n = np.where(bit, level.ones[here], level.zeros[here])
            own = (n + 0.5) / (level.zeros[here] + level.ones[here] + 1)
            if d < depth:
                below, goes_on = levels[d + 1].find((context >> U64(8 * (depth - d - 1)) << U64(8)) | node)
            else:
                below, goes_on = here, np.zeros(len(on), bool)
            share = np.where(goes_on, level.stop[here], 1.0)
            mixed = np.where(seen, mixed + rest * share * own, mixed)
            rest = np.where(seen, rest * (1 - share), rest)
            here, seen = below, seen & goes_on
        total[on] += np.log10(mixed)
    return total


# -- Spark ---------------------------------------------------------------------------------------

def _block_grams(depth: int):
    def run(table: pa.Table) -> pa.Table:
        train = np.array(table.column("train").to_pylist(), bool)
        parts, waiting = [], 0
        for rows, (text, row, start, words, word_row) in _steps(table, "text"):
            own = train[rows]
            for keys, of in ((_grams(text, start, row, depth), row), (words, word_row)):
                learnt = own[of] if len(keys) else np.zeros(0, bool)
                k, n = sorted_distinct(keys[learnt])
                parts.append((k, n))
                k, _ = sorted_distinct(keys[~learnt])
                parts.append((k, np.zeros(len(k), np.int64)))
                waiting += 1
            if waiting >= 16:
                parts, waiting = [_merge(parts)], 0
        keys, counts = _merge(parts)
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array(np.full(len(keys), block, np.int32)), "key": pa.array(keys.view(np.int64)), "n": pa.array(counts)})
    return run


def _shallow_sums(depth: int, way: Decomposition):
    """Bucket to partial sums of its depth-2 nodes: counts, and log weights of their children."""
    def run(table: pa.Table) -> pa.Table:
        codes = way.leaves(table.column("key").to_numpy().view(U64))
        level = deep_levels(codes, table.column("n").to_numpy(), depth, way)[SHARED]
        parents = _parent(level.keys)
        order = np.argsort(parents, kind="stable")
        parents = parents[order]
        at = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1]))) if len(parents) else np.zeros(0, np.int64)
        sums = [np.add.reduceat(x[order], at) if len(at) else np.zeros(0) for x in (level.zeros, level.ones, level.log_weighted)]
        return pa.table({"node": pa.array(parents[at].view(np.int64)), **{c: pa.array(s, pa.float64()) for c, s in zip(("zeros", "ones", "below"), sums)}})
    return run


def _weigh_nodes(batches):
    for b in batches:
        zeros, ones, below = (b.column(c).to_numpy() for c in ("zeros", "ones", "below"))
        own = _log_kt(zeros, ones)
        weighted = np.logaddexp(_HALF + own, _HALF + below)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weighted), pa.array(np.exp(np.minimum(_HALF + own - weighted, 0)))],
                                         names=["node", "zeros", "ones", "log_weighted", "stop"])


def _top_levels(nodes: DataFrame) -> dict[int, Level]:
    """Depths 1 and 0 (65,535 nodes at most), from the weighted nodes of depth 2."""
    up = F.shiftleft(F.shiftrightunsigned("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(255))
    rows = nodes.groupBy(up.alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_weighted").alias("below"))
    got = rows.toArrow().sort_by("node")
    one = Level(*(got.column(c).to_numpy().view(U64) if c == "node" else got.column(c).to_numpy() for c in ("node", "zeros", "ones")))
    one.weigh(got.column("below").to_numpy())
    keys = one.keys & U64(255)
    distinct = np.unique(keys)
    at = np.searchsorted(distinct, keys)
    none = Level(distinct, np.bincount(at, one.zeros, len(distinct)), np.bincount(at, one.ones, len(distinct)))
    none.weigh(none.sum_children(one))
    return {0: none, 1: one}


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score, n_bytes of every row.

    ``train`` is a condition on the column ``id``; ``score`` and ``base_score`` are log10
    probabilities; the code length is -score / (log10(2) * n_bytes) bits a byte.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES))
    # dealt by id and text: copies of a text under other ids fall into other blocks
    deal = F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("block", deal).withColumn("train", F.coalesce(train, F.lit(False)))

    grams = stage(dealt.groupBy("block").applyInArrow(_block_grams(depth), "block int, key long, n long"), "block_grams")
    release_shuffles(spark)
    counts = stage(grams.groupBy("key").agg(F.sum("n").alias("n")), "gram_counts")
    release_shuffles(spark)
    words = counts.where("key < 0")
    known = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("kinds")).first()
    ends = dealt.where("train").count()
    n_train, n_kinds = int(known["tokens"]) + ends, int(known["kinds"]) + (ends > 0)

    contexts = counts.where("key >= 0")
    of_byte = contexts.groupBy(F.col("key").bitwiseAND(255).alias("byte")).agg(F.sum("n").alias("n")).collect()  # 256 rows at most
    frequency = np.zeros(256)
    frequency[[r["byte"] for r in of_byte]] = [r["n"] for r in of_byte]
    way = Decomposition(frequency)
    buckets = max(spark.sparkContext.defaultParallelism, -(-contexts.count() // BUCKET_GRAMS))
    shift = 8 * (depth + 1 - SHARED)
    contexts = contexts.withColumn("bucket", F.pmod(F.xxhash64(F.shiftrightunsigned("key", shift)), F.lit(buckets)).cast("int"))
    sums = contexts.groupBy("bucket").applyInArrow(_shallow_sums(depth, way), "node long, zeros double, ones double, below double")
    two = sums.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    two = stage(two.mapInArrow(_weigh_nodes, "node long, zeros double, ones double, log_weighted double, stop double"), "depth_two")
    top = _top_levels(two)

    def predict(left: pa.Table, right: pa.Table) -> pa.Table:
        codes = way.leaves(left.column("key").to_numpy().view(U64))
        levels = dict(top)
        middle = Level(right.column("node").to_numpy().view(U64), right.column("zeros").to_numpy(), right.column("ones").to_numpy())
        middle.stop = right.column("stop").to_numpy()[np.argsort(right.column("node").to_numpy().view(U64))]
        levels[2] = middle
        levels.update(deep_levels(codes, left.column("n").to_numpy(), depth, way))
        return pa.table({"key": left.column("key"), "value": pa.array(code_lengths(codes, levels, depth, way))})

    wanted = contexts.select("bucket", F.shiftrightunsigned("key", shift + 8).alias("context")).distinct()
    spread = two.withColumn("context", F.shiftrightunsigned("node", 8)).join(wanted, "context").select(
        F.col("bucket").alias("to_bucket"), "node", "zeros", "ones", "stop")
    predicted = contexts.groupBy("bucket").cogroup(spread.groupBy("to_bucket")).applyInArrow(predict, "key long, value double")
    values = stage(predicted.unionByName(words.select("key", F.col("n").cast("double").alias("value"))), "gram_values")
    drop(counts, two)
    release_shuffles(spark)

    per_block = grams.select("block", "key").join(values, "key")
    total = n_train + 0.5 * (n_kinds + 1)

    def sum_up(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, value = right.column("key").to_numpy().view(U64), right.column("value").to_numpy()
        order = np.argsort(keys)
        keys, value = keys[order], value[order]
        out = {c: [] for c in ("n_tokens", "n_known", "base_score", "score", "n_bytes")}
        for rows, (text, row, start, words, word_row) in _steps(left, "text"):
            n = rows.stop - rows.start
            c = value[np.searchsorted(keys, words)]
            base = np.log10((np.append(c, float(ends)) + 0.5) / total)
            tokens = np.bincount(word_row, minlength=n)
            out["n_tokens"].append(tokens + 1)
            out["n_known"].append(np.bincount(word_row, weights=c > 0, minlength=n).astype(np.int64) + (ends > 0))
            out["base_score"].append(np.bincount(word_row, weights=base[:-1], minlength=n) + base[-1])
            lengths = value[np.searchsorted(keys, _grams(text, start, row, depth))]
            out["score"].append(np.bincount(row, weights=lengths, minlength=n))
            out["n_bytes"].append(np.bincount(row, minlength=n))
        joined = {k: np.concatenate(v) for k, v in out.items()}
        return pa.table({"id": left.column("id"), **{k: pa.array(joined[k], pa.float64() if "score" in k else pa.int64()) for k in joined},
                         "train_tokens": pa.array(np.full(left.num_rows, n_train), pa.int64())})

    per_block = per_block.withColumnRenamed("block", "of_block")
    scored = dealt.select("id", "text", "block").groupBy("block").cogroup(per_block.groupBy("of_block")).applyInArrow(
        sum_up, f"id {kind}, n_tokens long, n_known long, base_score double, score double, n_bytes long, train_tokens long")
    return scored.withColumnRenamed("id", id_col)
