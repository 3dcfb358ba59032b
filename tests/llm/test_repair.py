"""Conversation repair against all edit sequences, and its hard cases."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from postmetrics.llm import q_repair, repair
from postmetrics.llm.registry import prepare

SCHEMA = "conv_id long, turn long, role string, text string, symbol string, seq long, cost long"
WHITE = " \t\n\x0b\x0c\r"


def plain_symbols(rows):
    """(role, text, fault) in order: fault b, d, t or ''."""
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(WHITE)
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain_repair(marked):
    """Cheapest (cost, audit, repaired) over all ways through the turns, by brute force over output shapes."""
    best = None
    n = len(marked)
    for inserts in itertools.product(range(3), repeat=n + 1):
        for edits in itertools.product("KRD", repeat=n):
            audit, cost, out, ok = "", 0, [], True
            for k in range(n + 1):
                audit += "I" * inserts[k]
                cost += 3 * inserts[k]
                out += [(None, "")] * inserts[k]
                if k == n:
                    break
                role, text, fault = marked[k]
                audit += edits[k]
                if edits[k] == "D":
                    cost += 4
                    continue
                if fault in ("b", "d"):
                    ok = False
                    break
                cost += (3 if edits[k] == "R" else 0) + (3 if fault == "t" else 0)
                out.append((role if edits[k] == "K" else None, text))
            if not ok:
                continue
            start = 1 if out and out[0][0] is not None and out[0][0][:1] == "s" else 0
            if (len(out) - start) % 2 or (start and len(out) == 1):
                continue
            shape = [("user", "assistant")[(i - start) % 2] for i in range(len(out))]
            if any(r is not None and i >= start and r[:1] != shape[i][:1] for i, (r, _) in enumerate(out)):
                continue
            made = [(r if r is not None else shape[i], t) for i, (r, t) in enumerate(out)]
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, made)
    return best


def test_every_short_conversation_is_repaired_at_the_least_cost():
    rnd = random.Random(4)
    for n in range(5):
        for _ in range(25 if n else 1):
            symbols = [rnd.choice("suaoSUAOd") for _ in range(n)]
            marked = [({"s": "system", "u": "user", "a": "assistant", "o": "tool", "d": "user"}[s.lower()], f"t{k}",
                       "d" if s == "d" else "t" if s.isupper() else "") for k, s in enumerate(symbols)]
            total = None
            for s in symbols:
                m = repair.symbol_matrix(s)
                total = m if total is None else repair.product(total, m)
            cost, audit, _ = plain_repair(marked)
            got = repair.whole(total) if symbols else repair.Entry(0, "")
            assert (got.cost, str(got.audit)) == (cost, audit), symbols


def test_rules_do_not_change_results():
    rnd = random.Random(8)
    rules = ["ua", chr(repair.FIRST_RULE) * 2, "s" + chr(repair.FIRST_RULE + 1), "dd"]
    known = repair.rule_matrices(rules)
    for _ in range(60):
        word = "".join(rnd.choice(["ua", "ua", "s", "d", "U", "a", "o"]) for _ in range(rnd.randint(1, 14)))
        coded = word
        for k, pair in enumerate(rules):
            coded = coded.replace(pair, chr(repair.FIRST_RULE + k))
        results = []
        for text in (word, coded):
            total = known[text[0]]
            for c in text[1:]:
                total = repair.product(total, known[c])
            best = repair.whole(total)
            results.append((best.cost, str(best.audit)))
        assert results[0] == results[1]


def test_ropes_order_like_strings():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("DK") for _ in range(rnd.randint(0, 6))) for _ in range(2))

        def rope(s):
            if len(s) < 2:
                return repair.Rope(s)
            cut = rnd.randint(1, len(s) - 1)
            return rope(s[:cut]) + rope(s[cut:])
        x, y = rope(a), rope(b)
        assert (x < y, str(x), str(y)) == (a < b, a, b)


def _conversations():
    rnd = random.Random(2)
    rows = []
    for c in range(60):
        for t in range(rnd.randint(0, 4)):
            rows.append((c, t * rnd.choice([1, 1, 2]), rnd.choice(["user", "assistant", "system", "tool", ""]),
                         rnd.choice(["Yes.", "No", " ", "", "What? \n", "Ok!", " ", "finé"])))
    rows += [(100, None, "user", "a."), (100, None, "user", "a."), (100, 3, None, None), (100, 7, "assistant", "b.")]
    rows += [(None, 0, "user", "q."), (None, 1, "assistant", "r.")]
    return rows


def _expected(rows, damaged=None):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        marked = plain_symbols(turns)
        cost, audit, made = plain_repair(marked)
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        faults = [m[2] for m in marked]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[c] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs),
                  cost, audit, digest, made)
    return out


@pytest.fixture(scope="module")
def conversations(spark):
    prepare(spark)
    rows = _conversations()
    return rows, spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)


def test_report_matches_brute_force(conversations):
    rows, df = conversations
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_report(df).collect()}
    assert got == {c: v[:8] for c, v in _expected(rows).items()}


def test_repaired_turns_are_the_reported_ones(conversations):
    rows, df = conversations
    got = {}
    for r in repair.repaired_turns(df).orderBy("conv_id", "position").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
        assert r.position == len(got[r.conv_id]) - 1
    assert got == {c: v[8] for c, v in _expected(rows).items() if v[8]}


def test_a_long_conversation_is_cut_into_blocks(spark, monkeypatch):
    """Blocks of 8 turns, two levels: the same repair as in one product."""
    prepare(spark)
    monkeypatch.setattr(repair, "BLOCK_BITS", 3)
    monkeypatch.setattr(repair, "FAN_BITS", 2)
    rnd = random.Random(6)
    rows = [(1, t, rnd.choice(["user", "assistant", "tool"]), rnd.choice([f"text {t}.", f"text {t}", "", "same."])) for t in range(300)]
    rows += [(2, 0, "user", "q."), (2, 1, "assistant", "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in repair.repair_report(df).collect()}
    marked = plain_symbols([(t, r, x) for c, t, r, x in rows if c == 1])
    total = None
    for role, _, fault in marked:
        s = role[0] if role[0] in "sua" else "o"
        m = repair.symbol_matrix("d" if fault in ("b", "d") else s.upper() if fault == "t" else s)
        total = m if total is None else repair.product(total, m)
    best = repair.whole(total)
    assert (got[1].cost, got[1].audit) == (best.cost, str(best.audit)) and got[2].audit == "KK"


def test_damage_and_dropped_conversations(spark):
    prepare(spark)
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    doubled = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 3)
    df = spark.createDataFrame([(dropped, 0, "user", "x."), (doubled, 0, "user", "y."), (None, 1, "user", "z.")],
                               "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in q_repair.op11(df).collect()}
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[doubled][2] == 1 and set(got) == {dropped, doubled, None}


def test_empty_table_and_long_text(spark):
    prepare(spark)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_report(empty).collect() == [] and q_repair.op11(empty).collect() == []
    long = spark.createDataFrame([(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "a.")], empty.schema)
    made = repair.repaired_turns(long).select(F.length("text").alias("n")).orderBy("n").collect()
    assert [r.n for r in made] == [2, 2_000_001]
