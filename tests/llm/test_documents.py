"""Document operators on a small table with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from postmetrics.llm import context_tree, line_dedup, minhash, packing, pu_quality, sentencepieces, suffix_dedup
from postmetrics.llm.byte_pieces import encoder
from postmetrics.llm.q_packing import vocabulary
from postmetrics.llm.q_sentencepieces import model_file
from postmetrics.llm.registry import prepare

SCHEMA = ("doc_id long, text string, source string, id long, node long, key string, component long, row string, own string, "
          "count long, block int, score double, n_lines string")


def _words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(n))


def _rows():
    rng = random.Random(5)
    base = [_words(rng, rng.randrange(60, 200)) for _ in range(12)]
    texts = [None, "", " \n\t ", "one", "One TWO three", "a b c d e", "A b c d E", "\x00\x1f odd space ▁ é"]
    texts += base
    for b in base[:4]:  # near copies
        w = b.split()
        w[len(w) // 2] = "changed"
        texts += [" ".join(w), b, b + " tail"]
    passage = _words(rng, 90)
    texts += [f"{_words(rng, 30)} {passage} {_words(rng, 30)}" for _ in range(3)]
    texts += ["x" * 3000, "ab" * 1500, "ab" * 1500 + "c", "line\n" * 500, _words(rng, 6000)]
    texts += [f"{_words(rng, 20)}\nShared  footer line \n{_words(rng, 20)}\n\nend {k}" for k in range(14)]
    rows = [(k, t, f"site{k % 13}") for k, t in enumerate(texts)]
    rows += [(None, base[0], None), (None, None, "site1"), rows[9], rows[9], (3, "other text under a used id", "site2")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    prepare(spark)
    wide = [(*r, 7, 8, "k", 9, "r", "o", 1, 2, 0.5, "n") for r in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    prepare(spark)
    return spark.createDataFrame([], SCHEMA)


def _tuples(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def _tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low)


# -- near-duplicates -------------------------------------------------------------------------------

def _components(rows, percent):
    sets = []
    for _, t, _ in rows:
        w = _tokens(t)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    use = [i for i, r in enumerate(rows) if r[0] is not None]
    for i in use:
        for j in use:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    smallest = defaultdict(lambda: 1 << 60)
    for i in use:
        smallest[find(i)] = min(smallest[find(i)], rows[i][0])
    return [(r[0], len(s), smallest[find(i)] if r[0] is not None else None,
             smallest[find(i)] == r[0] if r[0] is not None else True) for i, (r, s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_against_all_pairs(docs, rows, percent):
    got = _tuples(minhash.near_duplicates(docs, 5, percent), "doc_id", "n_shingles", "component_id", "kept")
    assert got == Counter(_components(rows, percent))


def test_minhash_blocks_of_a_large_group(spark, monkeypatch):
    """A group of chained near copies larger than a block: components are those of all pairs."""
    prepare(spark)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(3)
    base = _words(rng, 120).split()
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(1000)}"
        rows.append((k, " ".join(w), "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = _tuples(minhash.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept")
    assert got == Counter(_components(rows, 85))


def test_match_thresholds():
    for percent in (80, 85, 95):
        t = minhash.match_threshold(48, percent)
        p = percent / 100
        tail = sum(math.comb(48, k) * p ** k * (1 - p) ** (48 - k) for k in range(t))
        assert tail <= minhash.MISS < tail + math.comb(48, t) * p ** t * (1 - p) ** (48 - t)


# -- repeated strings ------------------------------------------------------------------------------

def _cut(rows, length):
    seen = Counter()
    raw = [(t or "").encode() for _, t, _ in rows]
    for b in raw:
        seen.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for (key, _, _), b in zip(rows, raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int(sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)))
        out.append((key, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("length", [400, 130])
def test_suffix_dedup_against_all_windows(docs, rows, length):
    got = _tuples(suffix_dedup.remove_repeats(docs, length), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == _cut(rows, length)


def test_suffix_dedup_query_returns_the_text_left(spark, tmp_path):
    """A shared passage of over 50 words goes from every text from 400 bytes on, a shorter one stays."""
    from postmetrics.llm.q_suffix_dedup import op5_suffix_dedup
    rng = random.Random(7)
    long, short = _words(rng, 90), _words(rng, 300)
    long, short = f" {long[:399]}", f" {short[:398]}"
    assert min(len(long.split()), len(short.split())) > 50
    heads, ends = "ABCD", "WXYZ"
    texts = [f"{h}{_words(rng, 30)}é{h}{p}{e}{_words(rng, 30)}" for h, e, p in zip(heads, ends, (long, long, short, short))]
    texts += [_words(rng, 200), None, texts[0][:300]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op5_suffix_dedup(spark, str(tmp_path)).collect()}
    want = {k: (t or "").replace(long, "") for k, t in enumerate(texts)}
    assert {k: r.text for k, r in got.items()} == want
    assert {k: r.n_removed for k, r in got.items()} == {k: len((t or "").encode()) - len(want[k].encode()) for k, t in enumerate(texts)}
    assert [got[k].n_removed for k in range(7)] == [400, 400, 0, 0, 0, 0, 0]


def test_sample_positions_do_not_depend_on_parts(monkeypatch):
    from postmetrics.llm.textops import prefix_sums
    raw = np.random.default_rng(1).integers(97, 100, 5000).astype(np.uint8)
    sums = prefix_sums(raw)
    whole = suffix_dedup.sample_positions(sums, 0, len(raw), 400)
    monkeypatch.setattr(suffix_dedup, "PART", 333)
    assert np.array_equal(whole, suffix_dedup.sample_positions(sums, 0, len(raw), 400))


# -- hashes of spans ---------------------------------------------------------------------------

def _letter_swaps(n):
    """Two words that swap two letters in Thue-Morse order: equal under any polynomial modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_span_hash_of_letter_swaps_and_places():
    from postmetrics.llm import textops
    one, two = _letter_swaps(2048)
    raw = np.frombuffer((one + "xyz" + two + one).encode(), np.uint8)
    at = np.array([0, 2051, 4099])
    keys = textops.span_hash(textops.prefix_sums(raw), at, at + 2048)
    assert keys[0] == keys[2] != keys[1]
    rng = np.random.default_rng(2)
    buf = np.tile(rng.integers(0, 256, 40_000).astype(np.uint8), 2)
    start = rng.integers(0, 40_000, 3000)
    end = np.minimum(start + rng.integers(0, 300, 3000), 40_000)
    sums = textops.prefix_sums(buf)
    first, again = textops.span_hash(sums, start, end), textops.span_hash(sums, start + 40_000, end + 40_000)
    assert np.array_equal(first, again)
    assert len(set(first.tolist())) == len({buf[a:b].tobytes() for a, b in zip(start, end)})


def test_operators_tell_letter_swaps_apart(spark):
    import sentencepiece
    import tokenizers
    import zlib
    from postmetrics.llm import q_packing, q_sentencepieces
    one, two = _letter_swaps(4096)
    texts = [one, two, one + " tail", two + " tail"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    piece = sentencepiece.SentencePieceProcessor(model_file=q_sentencepieces.model_file())
    got = {r.doc_id: r.ids for r in sentencepieces.encode(df, q_sentencepieces.model_file()).collect()}
    assert got == {k: piece.encode(t) for k, t in enumerate(texts)}
    library = tokenizers.Tokenizer.from_file(q_packing.vocabulary())
    crc = {}
    for r in packing.pack_documents(df, q_packing.vocabulary()).orderBy("doc_id", "start").collect():
        crc.setdefault(r.doc_id, []).append((r.length, r.ids_crc32))
    for k, t in enumerate(texts):
        ids, at = library.encode(t, add_special_tokens=False).ids + [0], 0
        for length, value in crc[k]:
            assert zlib.crc32(np.asarray(ids[at:at + length], "<u4").tobytes()) == value
            at += length
    sets = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.near_duplicates(df, 5, 85).collect()}
    assert sets == {k: (k, 1) for k in range(4)}
    cut = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df, 400).collect()}
    assert cut == {r[0]: r[2] for r in _cut([(k, t, None) for k, t in enumerate(texts)], 400)}


# -- lines -----------------------------------------------------------------------------------------

def test_line_dedup(docs, rows):
    sites, texts = defaultdict(set), defaultdict(set)
    for _, t, site in rows:
        for line in (t or "").split("\n"):
            if line.strip(" "):
                texts[line.strip(" ")].add(t)
                if site is not None:
                    sites[line.strip(" ")].add(site)
    bad = {k for k in texts if len(sites[k]) >= 10 and len(texts[k]) >= 10}
    assert bad == {"Shared  footer line"}
    want = Counter()
    for key, t, _ in rows:
        kept = [x for x in (t or "").split("\n") if x.strip(" ") not in bad]
        n = len((t or "").split("\n"))
        want[(key, "\n".join(kept), n, n - len(kept), 7)] += 1
    assert _tuples(line_dedup.remove_boilerplate(docs, 10), "doc_id", "text", "n_lines", "n_lines_removed", "id") == want


def test_line_dedup_near_threshold_is_exact(spark):
    prepare(spark)
    rows = [(k * 100 + s, f"text {k} {s}\nline {k}", f"s{s}") for k in (9, 10, 11) for s in range(k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert line_dedup.boilerplate_lines(df, 10).count() == 2


# -- tokens ----------------------------------------------------------------------------------------

def test_sentencepieces_equal_the_library(docs, rows):
    model = sentencepieces.codec(model_file()).model
    want = Counter()
    for key, t, _ in rows:
        ids = model.encode(t or "")
        want[(key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256(model.decode(ids).encode()).hexdigest())] += 1
    assert _tuples(sentencepieces.digest(docs, model_file()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_sentencepieces_round_trip(docs, rows):
    texts = sentencepieces.decode(sentencepieces.encode(docs, model_file()), model_file())
    want = Counter((k, (t or "").replace("▁", " ")) for k, t, _ in rows)
    assert _tuples(texts, "doc_id", "text") == want


def test_sentencepieces_random_texts():
    import pyarrow as pa
    c = sentencepieces.codec(model_file())
    rng = random.Random(2)
    texts = ["".join(rng.choices(" \n\tabcé<s>▁0.", k=rng.randrange(30))) for _ in range(3000)]
    texts += ["".join(rng.choices(" \n\tabcé<s>0.", k=rng.randrange(30))) for _ in range(3000)]
    got = []
    for _, ids, size in c.encode(pa.array(texts)):
        got += np.split(ids, np.cumsum(size)[:-1])
    assert [g.tolist() for g in got] == [c.model.encode(t) for t in texts]


def test_packing_pieces_and_windows(docs, rows):
    whole = encoder(vocabulary()).whole
    packed = packing.pack_documents(docs, vocabulary(), keep_ids=True).persist()
    got = packed.collect()
    per_text = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 1024
        per_text[(r["doc_id"], r["doc_tokens"])].append((r["start"], tuple(r["ids"])))
    want = defaultdict(list)
    for key, t, _ in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        want[(key, len(ids))] += [(a, tuple(ids[a:a + 1024])) for a in range(0, len(ids), 1024)]
    assert {k: Counter(v) for k, v in per_text.items()} == {k: Counter(v) for k, v in want.items()}
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(windows) <= math.ceil(sum(r["length"] for r in got) / 1024) + 1
    for r in packing.sequences(packed).collect():
        n = r["n_tokens"]
        assert len(r["ids"]) == (n if n & (n - 1) == 0 else 1024)


def test_best_fit_decreasing_takes_the_tightest_window():
    rng = random.Random(4)
    lengths = np.array([rng.randrange(1, 65) for _ in range(500)])
    number, offset = packing.best_fit_decreasing(lengths, 64)
    room = {}
    for i in np.argsort(-lengths, kind="stable").tolist():  # brute force
        n = int(lengths[i])
        fits = [c for c in room.values() if c >= n]
        if number[i] in room:
            assert room[number[i]] == min(fits) and offset[i] == 64 - room[number[i]]
        else:
            assert not fits and offset[i] == 0
        room[number[i]] = room.get(number[i], 64) - n


def test_byte_pieces_random_texts():
    import pyarrow as pa
    c = encoder(vocabulary())
    rng = random.Random(6)
    for alphabet in (" \n\tabc 'sé1.\r\x0b<|endoftext|>", " \n\ta b\x85 '日1\x1c"):
        texts = ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(2000)]
        got = []
        for _, ids, size in c.encode(pa.array(texts)):
            got += np.split(ids, np.cumsum(size)[:-1])
        want = c.whole.encode_batch(texts, add_special_tokens=False)
        assert [g.tolist() for g in got] == [w.ids for w in want]


def test_byte_pieces_added_tokens():
    import pyarrow as pa
    from tokenizers import Tokenizer
    fresh = Tokenizer.from_file(vocabulary())
    rng = random.Random(8)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "a", "b c", "é", "\u3000"]
    texts = ["a <|endoftext|> b"] + ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(2000)]
    for some in ([t] for t in texts):  # one by one, so that no text takes the path of another
        (_, ids, size), = encoder(vocabulary()).encode(pa.array(some))
        assert ids.tolist() == fresh.encode(some[0], add_special_tokens=False).ids and size.tolist() == [len(ids)]
    got = []
    for _, ids, size in encoder(vocabulary()).encode(pa.array(texts)):
        got += np.split(ids, np.cumsum(size)[:-1])
    assert [g.tolist() for g in got] == [w.ids for w in fresh.encode_batch(texts, add_special_tokens=False)]
    assert got[0].tolist() == [64, 220, 50256, 275]


# -- scores ----------------------------------------------------------------------------------------

def test_context_tree_baseline_and_tree(docs, rows):
    from pyspark.sql import functions as F
    got = context_tree.score(docs, F.col("id") % 5 != 1).collect()
    assert len(got) == len(rows)
    learnt = [t for k, t, _ in rows if k is not None and k % 5 != 1]
    count = Counter(w for t in learnt for w in [*_tokens(t), "\n"])
    total, kinds = sum(count.values()), len(count)
    want = Counter()
    for key, t, _ in rows:
        w = [*_tokens(t), "\n"]
        base = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)
        want[(key, len(w), sum(count[x] > 0 for x in w), total, round(base, 6))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want

    # the tree, node by node, for every text
    tree = _PlainTree([_canonical(t) for t in learnt], context_tree.DEPTH)
    plain = Counter((key, round(tree.log10(_canonical(t)), 6)) for key, t, _ in rows if len(t or "") < 400)
    mine = Counter((r["doc_id"], round(r["score"], 6)) for r in got)
    assert all(mine[k] >= n for k, n in plain.items())


def _canonical(text):
    return " ".join(_tokens(text)).encode() + b"\n"


class _PlainTree:
    """Context-tree weighting, recursively and with dictionaries."""

    def __init__(self, texts, depth):
        self.depth, self.count = depth, defaultdict(lambda: [0, 0])
        freq = Counter(b for t in texts for b in t)
        self.way = context_tree.Decomposition(np.array([freq[b] for b in range(256)]))
        for t in texts:
            for context, byte in self._positions(t):
                for node, bit in self._path(byte):
                    for d in range(depth + 1):
                        self.count[(context[:d], node)][bit] += 1
        self.children = defaultdict(set)
        for context, node in self.count:
            if context:
                self.children[(context[:-1], node)].add(context)
        self.log_weighted = {}
        for d in range(depth, -1, -1):
            for (context, node), (a, b) in list(self.count.items()):
                if len(context) == d:
                    own = self._kt(a, b)
                    below = sum(self.log_weighted[(c, node)] for c in self.children[(context, node)])
                    self.log_weighted[(context, node)] = own if d == depth else np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)

    def _positions(self, text):
        padded = b"\n" * self.depth + text
        for i, byte in enumerate(text):
            yield tuple(padded[i:i + self.depth][::-1]), byte

    def _path(self, byte):
        leaf = int(self.way.leaf[byte])
        return [(int(self.way.node[leaf, j]), int(self.way.bit[leaf, j])) for j in range(self.way.steps[leaf])]

    @staticmethod
    def _kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def _predict(self, context, node, bit, d):
        if (context[:d], node) not in self.count:
            return 0.5
        n = self.count[(context[:d], node)]
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if d == self.depth or (context[:d + 1], node) not in self.count:
            return own
        stop = math.exp(min(0.0, math.log(0.5) + self._kt(*n) - self.log_weighted[(context[:d], node)]))
        return stop * own + (1 - stop) * self._predict(context, node, bit, d + 1)

    def log10(self, text):
        return sum(math.log10(self._predict(c, node, bit, 0)) for c, byte in self._positions(text) for node, bit in self._path(byte))


def test_quality_separates_and_covers_all_rows(spark, docs, rows):
    rng = random.Random(8)
    good = [(k, _words(rng, 80) + ".", 1) for k in range(150)]
    bad = [(1000 + k, "!! ".join(_words(rng, 60).upper().split()) + " ### $$$", 0) for k in range(60)]
    corpus = spark.createDataFrame([(k, t) for k, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in good[:100]], "doc_id long, quality int")
    model = pu_quality.train(corpus, labels)
    got = {r["doc_id"]: r["score"] for r in pu_quality.score(corpus, model).collect()}
    assert min(got[k] for k, _, _ in good) > max(got[k] for k, _, _ in bad)
    assert 0.55 < model.prior < 0.9
    scored = pu_quality.score(docs, model, keep=["doc_id", "row"]).collect()
    assert Counter(r["row"]["doc_id"] for r in scored) == Counter(k for k, _, _ in rows)
    assert all(0 <= r["score"] <= 1 for r in scored)
    none = pu_quality.score(docs, pu_quality.train(docs, labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.5}


# -- empty tables ----------------------------------------------------------------------------------

def test_empty_tables(spark, empty):
    from pyspark.sql import functions as F
    assert minhash.near_duplicates(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert line_dedup.remove_boilerplate(empty).count() == 0
    assert sentencepieces.digest(empty, model_file()).count() == 0
    assert packing.pack_documents(empty, vocabulary()).count() == 0
    assert context_tree.score(empty, F.col("id") > 0).count() == 0
    assert pu_quality.score(empty, None).count() == 0
