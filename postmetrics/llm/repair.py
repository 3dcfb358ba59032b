"""Conversation structure repair: the cheapest edits that give every conversation a lawful shape.

A lawful conversation is empty, or pairs of a user and an assistant turn after at most one system
turn.  Turns are taken by turn (nulls first), then role, then text.  A turn is *blank* (white space
only), else a *duplicate* (its role and text stood earlier in the conversation), else *truncated*
(its last visible character is none of ``.!?``), else sound.  Edits: Keep (0), Rerole to user or
assistant (3), Delete (4; the only one for blank and duplicate turns), Insert an empty user or
assistant turn anywhere (3); a truncated turn that stays costs 3 more.  Of equally cheap repairs the
one whose audit (the initials of its edits in order) comes first in ASCII is taken.

How: a turn becomes one of nine symbols (role and fault), a conversation a string of symbols, cut
into blocks of at most ``BLOCK`` turns.  Distinct strings are solved once.  Re-Pair rules replace
the pairs that are most frequent over *all* strings, in rounds of one aggregation each.  Every symbol
is a 4 x 4 matrix over the states of the shape (nothing, after system, after user, after assistant)
in the semiring of (cost, audit): min by cost, then by audit; a rule's matrix is the product of its
two parts, evaluated bottom-up once and shared by all strings that use the rule.  Audits are ropes,
so a product costs no copying.  Blocks of one conversation are multiplied in order, level by level.
The minimum is distributive because two audits over the same turns with equal costs are never
prefixes of each other (their difference would be insertions, which cost).

Turns are dealt by a range sort, so a conversation that holds a third of all rows is spread over
tasks; only its digest, which is by definition one sequential pass over its text, is one task's
stream, in bounded memory.

Defined results: null roles and texts count as one blank; an initial other than s, u, a (or none) is
never kept; a null conversation id is a conversation of its own; null turns come first and count
in no gap; repeated rows are duplicates; texts of any length pass through in Arrow batches bounded
by bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import namedtuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmetrics.llm.staging import stage

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Turns per block: 2**BLOCK_BITS; children of one inner product: 2**FAN_BITS.
BLOCK_BITS, FAN_BITS = 10, 8
ROUNDS, PAIRS_A_ROUND = 6, 8
WHITE = " \t\n\x0b\x0c\r"
#: Symbols of rules start here (turn symbols are ASCII letters).
FIRST_RULE = 0x4E00
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)


# ---------------------------------------------------------------- ropes and matrices

class Rope:
    """A string as a tree of concatenations."""

    __slots__ = ("left", "right", "leaf", "size")

    def __init__(self, leaf: str = "", left: "Rope | None" = None, right: "Rope | None" = None):
        self.leaf, self.left, self.right = leaf, left, right
        self.size = left.size + right.size if left is not None else len(leaf)

    def __add__(self, other: "Rope") -> "Rope":
        if not self.size:
            return other
        return self if not other.size else Rope("", self, other)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                out.append(node.leaf)
            else:
                todo += [node.right, node.left]
        return "".join(out)

    def __lt__(self, other: "Rope") -> bool:
        """By code points; shared parts are passed over, nothing is copied."""
        mine, theirs = [self], [other]
        while mine and theirs:
            a, b = mine.pop(), theirs.pop()
            if a is b:
                continue
            if a.left is None and b.left is None:
                n = min(a.size, b.size)
                if a.leaf[:n] != b.leaf[:n]:
                    return a.leaf[:n] < b.leaf[:n]
                if a.size > n:
                    mine.append(Rope(a.leaf[n:]))
                elif b.size > n:
                    theirs.append(Rope(b.leaf[n:]))
            elif a.left is not None and (b.left is None or a.size >= b.size):
                mine += [a.right, a.left]
                theirs.append(b)
            else:
                theirs += [b.right, b.left]
                mine.append(a)
        return bool(theirs)


Entry = namedtuple("Entry", "cost audit")


def better(a: Entry | None, b: Entry | None) -> Entry | None:
    if a is None or b is None:
        return a if b is None else b
    if a.cost != b.cost:
        return a if a.cost < b.cost else b
    return b if b.audit < a.audit else a


def product(a: list, b: list) -> list:
    """Min-plus product of two matrices of entries (None: no way)."""
    out = []
    for row in a:
        line = [None] * 4
        for k in STATES:
            if row[k] is not None:
                for j in STATES:
                    if b[k][j] is not None:
                        line[j] = better(line[j], Entry(row[k].cost + b[k][j].cost, row[k].audit + b[k][j].audit))
        out.append(line)
    return out


def _matrix(ways: dict) -> list:
    return [[Entry(*ways[i, j]) if (i, j) in ways else None for j in STATES] for i in STATES]


_NONE, _I, _II, _D, _K, _R = (Rope(s) for s in ("", "I", "II", "D", "K", "R"))
#: Insertions before a turn or at the end; more than two in a row never pay.
INSERTIONS = _matrix({**{(i, i): (0, _NONE) for i in STATES},
                      **{(i, USER): (INSERT, _I) for i in (START, SYSTEM, ASSISTANT)}, (USER, ASSISTANT): (INSERT, _I),
                      **{(i, ASSISTANT): (2 * INSERT, _II) for i in (START, SYSTEM)}})


def symbol_matrix(symbol: str) -> list:
    """Insertions, then the edit of one turn: s u a o sound, S U A O truncated, d to be deleted."""
    ways = {(i, i): (DELETE, _D) for i in STATES}
    if symbol != "d":
        extra, role = (TRUNCATED if symbol.isupper() else 0), symbol.lower()
        to_user = (extra, _K) if role == "u" else (REROLE + extra, _R)
        ways.update({(i, USER): to_user for i in (START, SYSTEM, ASSISTANT)})
        ways[USER, ASSISTANT] = (extra, _K) if role == "a" else (REROLE + extra, _R)
        if role == "s":
            ways[START, SYSTEM] = (extra, _K)
    return product(INSERTIONS, _matrix(ways))


def rule_matrices(rules: list[str]) -> dict:
    """Matrix of every turn symbol and, bottom-up, of every rule (rule k stands for a pair of symbols)."""
    out = {s: symbol_matrix(s) for s in "suaoSUAOd"}
    for k, pair in enumerate(rules):
        out[chr(FIRST_RULE + k)] = product(out[pair[0]], out[pair[1]])
    return out


def whole(matrix: list) -> Entry:
    """The best repair of a conversation with this matrix."""
    ended = product(matrix[:1], INSERTIONS)[0]
    return better(ended[START], ended[ASSISTANT])


# ---------------------------------------------------------------- turns and their symbols

def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text and ``seq``, which numbers all rows in order (staged)."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    # range bounds need not see whole texts: a prefix keeps their order
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
    placed = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    return stage(placed.withColumn("seq", F.monotonically_increasing_id()), "turns")


def marked_turns(rows: DataFrame) -> DataFrame:
    """conv_id, seq, symbol of every row of ``ordered_turns`` (staged; b blank, d duplicate, the rest as
    in ``symbol_matrix``)."""
    visible = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    narrow = rows.select(
        "conv_id", "seq", (visible == "").alias("blank"), (~F.right(visible, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("content"))
    firsts = narrow.groupBy("conv_id", "content").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("is_first"))
    symbol = (F.when(F.col("blank"), "b").when(F.col("is_first").isNull(), "d")
              .when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial")))
    return stage(narrow.join(firsts, "seq", "left").select("conv_id", "seq", symbol.alias("symbol")), "marked_turns")


# ---------------------------------------------------------------- grammar

def _encode(text: Column, rules: list[str]) -> Column:
    for k, pair in enumerate(rules):
        text = F.replace(text, F.lit(pair), F.lit(chr(FIRST_RULE + k)))
    return text


def grammar(words: DataFrame, rounds: int = ROUNDS, most: int = PAIRS_A_ROUND) -> list[str]:
    """Re-Pair rules from the frequencies of adjacent symbols over all ``words`` (symbols, n).

    A round counts all pairs once and takes the most frequent ones that do not compete for a symbol.
    """
    rules: list[str] = []
    for _ in range(rounds):
        letters = F.split(_encode(F.col("symbols"), rules), "")
        coded = words.select(letters.alias("w"), "n").where(F.size("w") > 1)
        pairs = coded.select("n", F.explode(F.zip_with(
            F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda x, y: F.concat(x, y))).alias("pair"))
        top = pairs.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "pair").limit(4 * most).collect()
        lefts, rights, chosen = set(), set(), []
        for r in top:
            x, y = r["pair"][0], r["pair"][1]
            if len(chosen) < most and x not in rights and y not in lefts:
                lefts.add(x), rights.add(y), chosen.append(r["pair"])
        if not chosen:
            break
        rules += chosen
    return rules


_MATRIX = "costs array<int>, audits array<string>"


def _packed(matrix: list) -> tuple[list, list]:
    flat = [e for row in matrix for e in row]
    return [None if e is None else e.cost for e in flat], [None if e is None else str(e.audit) for e in flat]


def _unpacked(costs, audits) -> list:
    flat = [None if c is None else Entry(c, Rope(a)) for c, a in zip(costs, audits)]
    return [flat[4 * i:4 * i + 4] for i in STATES]


def solve_words(words: DataFrame, rules: list[str]) -> DataFrame:
    """symbols, the cost and audit of a conversation of these symbols, and their matrix."""
    def run(batches):
        known = rule_matrices(rules)
        for b in batches:
            out = []
            for coded in b.column("coded").to_pylist():
                total = known[coded[0]]
                for c in coded[1:]:
                    total = product(total, known[c])
                best = whole(total)
                out.append((best.cost, str(best.audit), *_packed(total)))
            cost, audit, costs, audits = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("symbols"), pa.array(cost, pa.int64()), pa.array(audit, pa.string()),
                 pa.array(costs, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string()))],
                names=["symbols", "cost", "audit", "costs", "audits"])

    coded = words.select("symbols", _encode(F.col("symbols"), rules).alias("coded"))
    return coded.mapInArrow(run, f"symbols string, cost long, audit string, {_MATRIX}")


def _chain(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The product, in order of ``first``, of the matrices of every group (at most 2**FAN_BITS parts of a
    range, or the ranges of one conversation)."""
    kind = parts.schema["conv_id"].dataType.simpleString()

    def fold(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("first")
        total = None
        for costs, audits in zip(table.column("costs").to_pylist(), table.column("audits").to_pylist()):
            own = _unpacked(costs, audits)
            total = own if total is None else product(total, own)
        best, (costs, audits) = whole(total), _packed(total)
        return pa.table({"conv_id": table.column("conv_id")[:1], "first": table.column("first")[:1], "cost": [best.cost],
                         "audit": [str(best.audit)], "costs": pa.array([costs], pa.list_(pa.int32())),
                         "audits": pa.array([audits], pa.list_(pa.string()))})

    return parts.groupBy(*keys).applyInArrow(fold, f"conv_id {kind}, first long, cost long, audit string, {_MATRIX}")


def cheapest_repairs(marked: DataFrame) -> DataFrame:
    """conv_id, first (the seq of its first turn), cost and audit of every conversation."""
    symbol = F.when(F.col("symbol") == "b", "d").otherwise(F.col("symbol"))
    listed = F.array_sort(F.collect_list(F.struct("seq", symbol.alias("symbol"))))
    blocks = stage(marked.groupBy("conv_id", F.shiftright("seq", BLOCK_BITS).alias("block")).agg(
        F.min("seq").alias("first"), F.array_join(F.transform(listed, lambda t: t["symbol"]), "").alias("symbols")), "blocks")
    words = stage(blocks.groupBy("symbols").agg(F.count("*").alias("n")), "words")
    solved = solve_words(words, grammar(words))
    parts = stage(blocks.join(solved, "symbols").select("conv_id", "first", "cost", "audit", "costs", "audits"), "block_matrices")
    whole_ones = parts.groupBy("conv_id").agg(
        F.count("*").alias("blocks"), F.min("first").alias("first"), F.min("cost").alias("cost"), F.min("audit").alias("audit"))
    single = whole_ones.where("blocks = 1").select("conv_id", "first", "cost", "audit")
    several = whole_ones.where("blocks > 1").select(F.col("conv_id").alias("c"))
    cut = parts.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    ranges = _chain(cut.withColumn("range", F.shiftright("first", BLOCK_BITS + FAN_BITS)), ["conv_id", "range"])
    return single.unionByName(_chain(ranges, ["conv_id"]).select("conv_id", "first", "cost", "audit"))


# ---------------------------------------------------------------- results

class Walk:
    """One conversation, turn by turn: its faults and its repaired turns."""

    def __init__(self, conv_id, cost: int, audit: str):
        self.conv_id, self.cost, self.audit = conv_id, cost, audit
        self.at, self.out = 0, 0
        self.offset = 0
        self.counts = {"b": 0, "d": 0, "cut": 0, "illegal": 0}
        self.before = self.low = self.last = None
        self.turns = 0
        self.digest = hashlib.sha256()

    def _emit(self, role: str | None, text: str) -> tuple[str, str]:
        """A repaired turn; without a role it is the one that the shape asks for here."""
        if role is not None and self.out == 0 and role[:1] == "s":
            self.offset = 1
        role = role if role is not None else ("user", "assistant")[(self.out - self.offset) % 2]
        self.digest.update(f"{chr(10) if self.out else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.out += 1
        return role, text

    def _insertions(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._emit(None, "")

    def turn(self, turn, role: str, text: str, symbol: str):
        """The repaired turns up to and with this one."""
        kind = symbol if symbol in "bd" else "cut" if symbol.isupper() else None
        if kind:
            self.counts[kind] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = role[:1]
        if turn is not None and turn != self.last:
            self.low = turn if self.low is None else self.low
            self.last, self.turns = turn, self.turns + 1
        yield from self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._emit(role if edit == "K" else None, text)

    def end(self):
        yield from self._insertions()

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.last - self.low + 1 - self.turns
        c = self.counts
        return self.conv_id, gaps, c["b"], c["d"], c["cut"], c["illegal"], self.cost, self.audit, self.digest.hexdigest()


def _streamed(rows: DataFrame, marked: DataFrame, repairs: DataFrame) -> DataFrame:
    """Rows of one conversation together and in order; its repair, then each mark before its turn."""
    def part(df, kind, **columns):
        names = {"turn": "long", "role": "string", "text": "string", "symbol": "string", "cost": "long", "audit": "string"}
        return df.select("conv_id", columns.get("seq", F.col("seq")).alias("seq"), F.lit(kind).alias("kind"),
                         *[(columns[n] if n in columns else F.lit(None)).cast(t).alias(n) for n, t in names.items()])

    one = part(repairs, 0, seq=F.col("first"), cost=F.col("cost"), audit=F.col("audit"))
    two = part(marked, 1, symbol=F.col("symbol"))
    three = part(rows, 2, turn=F.col("turn"), role=F.col("role"), text=F.col("text"))
    return one.unionByName(two).unionByName(three).repartition("conv_id").sortWithinPartitions("seq", "kind")


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _walks(batches, turns: bool):
    """Streams rows of ``_streamed``; per batch, the summaries of ended conversations or the repaired turns."""
    walk, symbol = None, None
    for b in batches:
        found = []
        for row in zip(*(b.column(n).to_pylist() for n in ("conv_id", "kind", "turn", "role", "text", "symbol", "cost", "audit"))):
            conv_id, kind, turn, role, text, mark, cost, audit = row
            if kind == 0:
                found += _ended(walk, turns)
                walk = Walk(conv_id, cost, audit)
            elif kind == 1:
                symbol = mark
            else:
                made = list(walk.turn(turn, role, text, symbol))
                if turns:
                    found += [(conv_id, walk.out - len(made) + i, *t) for i, t in enumerate(made)]
        yield found
    yield _ended(walk, turns)


def _ended(walk: Walk | None, turns: bool) -> list:
    if walk is None:
        return []
    made = list(walk.end())
    if not turns:
        return [walk.summary()]
    return [(walk.conv_id, walk.out - len(made) + i, *t) for i, t in enumerate(made)]


def _run(turns: bool, schema: pa.Schema):
    def run(batches):
        for found in _walks(batches, turns):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
    return run


def _repair(turns: DataFrame, wanted: str, whole_turns: bool, columns: dict) -> DataFrame:
    rows = ordered_turns(turns, **columns)
    marked = marked_turns(rows)
    streamed = _streamed(rows, marked, cheapest_repairs(marked))
    out = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {wanted}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return streamed.mapInArrow(_run(whole_turns, to_arrow_schema(StructType.fromDDL(out))), out)


def repaired_turns(turns: DataFrame, **columns) -> DataFrame:
    """conv_id, position (from 0), role, text: the repaired conversations."""
    return _repair(turns, "position long, role string, text string", True, columns)


def repair_report(turns: DataFrame, **columns) -> DataFrame:
    """Per conversation: gaps among its turns, faults, illegal neighbours, cost, audit and a digest of
    its repaired turns."""
    return _repair(turns, _SUMMARY, False, columns)
