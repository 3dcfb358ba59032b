"""Near-duplicate documents by a signature-coordinate inverted join.

A document is the set of its word shingles.  Each of ``COORDINATES`` min-hash values matches between
two documents with a chance equal to their Jaccard similarity, so a linked pair (similarity at least
``percent`` in 100) has at least ``matches`` equal values but for a chance of ``MISS``.

The first ``POSTED`` coordinates are posted as (coordinate, value) keys.  A linked pair shares at
least ``posted_matches`` of them (same chance), hence at least one of its ``POSTED - posted_matches
+ 1`` rarest keys (prefix); frequent keys, long posting lists, are passed over unless a document has little else.
Inside a list the collisions of a pair are counted over all coordinates, and only at the first key
its two prefixes share; later lists skip it.  Pairs above the match threshold are confirmed on their
full shingle sets.

Documents with equal sets are one class from the start.  Every list first links its members to one
of them; then only pairs of still different components are counted, in blocks of at most ``BLOCK``
members; a block's likely pairs travel as one row per member, and only links that join what was still
apart leave it.  So a large group of copies makes rows in proportion to its size, and no group is
held by one task.

Words are lower-cased (A-Z) runs of bytes other than ASCII white space.  Defined results: a document
with fewer words than a shingle is that one sequence; a null text or one without words has an empty
set and links with nothing; a null id links with nothing, has a null component and is kept; repeated
rows are copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmetrics.llm.components import connected_components
from postmetrics.llm.staging import drop, release_shuffles, stage
from postmetrics.llm.textops import LOWER, U64, mix, prefix_sums, row_slices, sorted_distinct, span_hash, text_buffer, word_spans

COORDINATES, POSTED = 128, 48
MISS = 4e-6
BLOCK = 512
STEP_BYTES = 1 << 19

_rng = np.random.default_rng(7_919)
_XOR = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.int64).astype(U64)
_FACTOR = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def match_threshold(coordinates: int, percent: int, miss: float = MISS) -> int:
    """Largest number of matches that a pair at the similarity threshold falls below with chance <= miss."""
    p, tail = percent / 100, 0.0
    for k in range(coordinates + 1):
        tail += math.comb(coordinates, k) * p ** k * (1 - p) ** (coordinates - k)
        if tail > miss:
            return k
    return coordinates


def shingle_sets(texts: pa.Array, words: int):
    """Yield (row, sorted distinct 64-bit shingle hashes) for every row of a string column."""
    buf, starts, ends = text_buffer(texts)
    for lo, hi in row_slices(starts, ends, STEP_BYTES):
        part = LOWER[buf[starts[lo]:ends[hi - 1]]]
        s, e, rows = word_spans(part, starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo])
        keys = span_hash(prefix_sums(part), s, e) if len(s) else np.zeros(0, U64)
        bound = np.searchsorted(rows, np.arange(hi - lo + 1))
        full = len(keys) - words + 1
        rolled = np.zeros(max(full, 0), U64)
        for k in range(words):
            if full > 0:
                rolled = mix(rolled * U64(31) + keys[k:k + full])
        for r in range(hi - lo):
            a, z = int(bound[r]), int(bound[r + 1])
            if z - a >= words:
                yield lo + r, sorted_distinct(rolled[a:z - words + 1])[0]
            elif z > a:
                whole = np.array([z - a], U64)
                for k in range(a, z):
                    whole = mix(whole * U64(31) + keys[k])
                yield lo + r, whole
            else:
                yield lo + r, np.zeros(0, U64)


def _minima(shingles: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, U64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 2048):
        part = shingles[at:at + 2048]
        out = np.minimum(out, ((part[None, :] ^ _XOR[:, None]) * _FACTOR[:, None]).min(1))
    return out


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, n_shingles, set_a, set_b (128-bit hash of the set), keys, sig: one row per document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        salt = mix(np.arange(POSTED, dtype=U64) + U64(1))
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                size, a, c, keys, sig = [], [], [], [], []
                for _, s in shingle_sets(part.column(2), words):
                    size.append(len(s))
                    a.append(int(mix(s).sum(dtype=U64)))
                    c.append(int(mix(s ^ U64(0x5DEECE66D)).sum(dtype=U64)))
                    low = _minima(s)
                    keys.append(mix(low[:POSTED] ^ salt).view(np.int64))
                    sig.append((low >> U64(48)).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(np.array(a, U64).view(np.int64)),
                     pa.array(np.array(c, U64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    names=["id", "text_hash", "n_shingles", "set_a", "set_b", "keys", "sig"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, text_hash long, n_shingles long, set_a long, set_b long, keys array<long>, sig binary")


def _matching(sig_x: pa.Array, sig_y: pa.Array) -> np.ndarray:
    x = np.frombuffer(b"".join(sig_x.to_pylist()), "<u2").reshape(-1, COORDINATES)
    y = np.frombuffer(b"".join(sig_y.to_pylist()), "<u2").reshape(-1, COORDINATES)
    return (x == y).sum(1)


def _above_threshold(pairs: DataFrame, sigs: DataFrame, matches: int) -> DataFrame:
    """Pairs (x, y) whose signatures match on at least ``matches`` coordinates."""
    def run(batches):
        for b in batches:
            keep = pa.array(_matching(b.column(2), b.column(3)) >= matches) if b.num_rows else pa.array([], pa.bool_())
            yield b.select([0, 1]).filter(keep)
    wide = (pairs.join(sigs.select(F.col("node").alias("x"), F.col("sig").alias("sx")), "x")
            .join(sigs.select(F.col("node").alias("y"), F.col("sig").alias("sy")), "y").select("x", "y", "sx", "sy"))
    return wide.mapInArrow(run, "x long, y long")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (x, y) with 100 * intersection >= percent * union on their full shingle sets."""
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                left = [s for _, s in shingle_sets(part.column(2), words)]
                right = [s for _, s in shingle_sets(part.column(3), words)]
                keep = [_linked(s, t, percent) for s, t in zip(left, right)]
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    wide = (pairs.join(texts.select(F.col("node").alias("x"), F.col("text").alias("tx")), "x")
            .join(texts.select(F.col("node").alias("y"), F.col("text").alias("ty")), "y").select("x", "y", "tx", "ty"))
    return wide.mapInArrow(run, "x long, y long")


def _groups(batches, columns: list):
    """Consecutive rows with equal ``columns`` as tables, across batch borders."""
    open_rows, open_key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        at = [b.column(c).to_numpy() for c in columns]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in at], axis=0)) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), b.num_rows]):
            own = tuple(int(c[lo]) for c in at)
            if own != open_key:
                if open_rows:
                    yield open_key, pa.Table.from_batches(open_rows).combine_chunks()
                open_rows, open_key = [], own
            open_rows.append(b.slice(lo, hi - lo))
    if open_rows:
        yield open_key, pa.Table.from_batches(open_rows).combine_chunks()


_LIST = ["key", "i", "j"]


def _likely_in_block(own: tuple, rows: pa.Table, matches: int) -> pa.RecordBatch | None:
    """Members of one list (or of two blocks of it) with their later partners above the threshold.

    A pair counts here only if this is the first key that its two prefixes share.
    """
    key, i, j = own
    node, component, block = (rows.column(c).to_numpy() for c in ("node", "component", "blk"))
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u2").reshape(-1, COORDINATES)
    prefix = None
    partners: dict[int, list] = {}
    for r in range(len(node) - 1):
        other = component[r + 1:] != component[r]
        if i != j:
            other &= block[r + 1:] != block[r]
        at = np.flatnonzero(other) + r + 1
        if len(at):
            at = at[(sig[at] == sig[r]).sum(1) >= matches]
        if len(at):
            prefix = prefix or [set(p) for p in rows.column("prefix").to_pylist()]
            at = [x for x in at.tolist() if min(prefix[r] & prefix[x]) == key]
        if len(at):
            partners[r] = node[at].tolist()
            for x in at:
                partners.setdefault(x, [])
    if not partners:
        return None
    n = len(partners)
    return pa.RecordBatch.from_arrays(
        [pa.array([key] * n, pa.int64()), pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()),
         pa.array(node[list(partners)], pa.int64()), pa.array(list(partners.values()), pa.list_(pa.int64()))],
        names=[*_LIST, "node", "partners"])


def _likely_in_lists(members: DataFrame, matches: int) -> DataFrame:
    """key, i, j, node, partners: one row for each member of a block that has a likely partner in it."""
    def run(batches):
        for own, rows in _groups(batches, _LIST):
            found = _likely_in_block(own, rows, matches)
            if found is not None:
                yield found
    return members.repartition(*_LIST).sortWithinPartitions(*_LIST).mapInArrow(
        run, "key long, i int, j int, node long, partners array<long>")


def _confirm_in_blocks(likely: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (x, y) of each block's likely pairs that join what the block's links had left apart.

    Confirmed on full shingle sets; pairs already joined by links of the same block are not needed
    for components and are passed over.
    """
    def run(batches):
        for _, rows in _groups(batches, _LIST):
            sets: dict[int, np.ndarray] = {}
            node = rows.column("node").to_pylist()
            for lo in range(0, len(node), 64):
                part = rows.column("text").slice(lo, 64).combine_chunks()
                for r, s in shingle_sets(part, words):
                    sets[node[lo + r]] = s
            root = {x: x for x in node}
            x_out, y_out = [], []
            for x, ys in zip(node, rows.column("partners").to_pylist()):
                for y in ys:
                    a, b = _root(root, x), _root(root, y)
                    if a != b and _linked(sets[x], sets[y], percent):
                        root[max(a, b)] = min(a, b)
                        x_out.append(x)
                        y_out.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x_out, pa.int64()), pa.array(y_out, pa.int64())], names=["x", "y"])
    wide = likely.join(texts, "node").select(*_LIST, "node", "partners", "text")
    return wide.repartition(*_LIST).sortWithinPartitions(*_LIST).mapInArrow(run, "x long, y long")


def _root(root: dict, x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(s), len(t)))
    if 100 * small < percent * large:
        return False
    both = np.sort(np.concatenate((s, t)))
    shared = int((both[1:] == both[:-1]).sum())
    return shared > 0 and 100 * shared >= percent * (len(both) - shared)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text",
                    text_hash: bool = False) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable), kept: one row for every document; with
    ``text_hash`` also that column, the xxhash64 of its text."""
    spark = docs.sparkSession
    matches = match_threshold(COORDINATES, percent)
    prefix_keys = POSTED - match_threshold(POSTED, percent) + 1
    rows = stage(signatures(docs, words, id_col, text_col), "signatures")
    usable = rows.where("n_shingles > 0 AND id IS NOT NULL")
    classes = usable.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("id", "text_hash")).alias("first"))
    classes = stage(classes.select("set_a", "set_b", "n_shingles", F.col("first.id").alias("rep"), F.col("first.text_hash").alias("rep_text"),
                                   F.monotonically_increasing_id().alias("node")), "numbered_classes")
    same_set = ["set_a", "set_b", "n_shingles"]
    nodes = stage(usable.join(classes, same_set).where("id = rep AND text_hash = rep_text").select("node", "keys", "sig"), "nodes")

    # posting lists, and the rarest keys of each document that anything shares
    posts = nodes.select("node", F.explode("keys").alias("key"))
    shared = posts.groupBy("key").count().where("count > 1")
    own = Window.partitionBy("node")
    ranked = posts.join(shared, "key").withColumn("n", F.count("*").over(own)).withColumn(
        "rank", F.row_number().over(own.orderBy("count", "key")))
    prefix = stage(ranked.where(F.col("rank") + POSTED - F.col("n") <= prefix_keys).select("node", "key"), "prefixes")
    lists = prefix.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("pivot")).where("members > 1")
    posted = stage(prefix.join(lists, "key"), "posted")
    release_shuffles(spark)

    # texts of the documents that stand in any list
    involved = posted.select("node").distinct().join(classes, "node").select("node", "rep", "rep_text")
    texts = docs.select(F.col(id_col).alias("rep"), F.xxhash64(text_col).alias("rep_text"), F.col(text_col).alias("text"))
    texts = stage(texts.join(involved, ["rep", "rep_text"]).select("node", "text"), "involved_texts")
    release_shuffles(spark)

    sigs = nodes.select("node", "sig")
    stars = stage(posted.where("node <> pivot").select(F.col("pivot").alias("x"), F.col("node").alias("y")).distinct(), "star_pairs")
    # written in between, so that a task runs one Python worker at a time
    likely_stars = stage(_above_threshold(stars, sigs, matches), "likely_star_pairs")
    star_links = stage(confirm(likely_stars, texts, words, percent).distinct(), "star_links")
    star_components = stage(connected_components(star_links.select(F.col("x").alias("a"), F.col("y").alias("b"))), "star_components")
    release_shuffles(spark)

    # what the stars left apart
    placed = posted.select("node", "key", "members").join(star_components.withColumnRenamed("vertex", "node"), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    placed = stage(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    prefixes = prefix.groupBy("node").agg(F.collect_list("key").alias("prefix"))
    open_lists = placed.join(mixed, "key", "left_semi").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn(
        "blk", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    open_lists = stage(open_lists.select("key", "node", "component", "blk", "blocks"), "open_lists")
    component = star_components
    if not open_lists.isEmpty():  # members of a list that its star left in different components
        described = open_lists.join(sigs, "node").join(prefixes, "node")
        described = described.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "node", "component", "blk", "sig", "prefix")
        likely = stage(_likely_in_lists(described, matches), "likely_members")
        links = _confirm_in_blocks(likely, texts, words, percent).select(F.col("x").alias("a"), F.col("y").alias("b"))
        # the stars' links are known by their components
        known = star_components.select(F.col("vertex").alias("a"), F.col("component").alias("b"))
        component = connected_components(links.unionByName(known))
    drop(texts, placed, open_lists, stars)
    release_shuffles(spark)

    # the smallest id of every component, back to all rows
    named = classes.join(component.withColumnRenamed("vertex", "node"), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    named = stage(named.select(*same_set, "rep", "component"), "named_classes")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = named.select(*same_set, "component").join(smallest, "component").drop("component")
    own = ["text_hash"] if text_hash else []
    out = rows.select("id", *own, *same_set).join(by_class, same_set, "left")
    reached = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    reached = F.when(F.col("id").isNotNull(), reached)
    return out.select(F.col("id").alias(id_col), "n_shingles", reached.alias("component_id"),
                      F.coalesce(reached == F.col("id"), F.lit(True)).alias("kept"), *own)
