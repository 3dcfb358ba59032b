"""Chat formatting with relational operators only.

Turns of a conversation are collected as structs and sorted; an aggregation over the array merges
adjacent turns of one role into blocks; blocks are concatenated.  The template::

    <turn:ROLE>
    first text<next/>
    second text</turn>

Inside roles and texts ``&`` and ``<`` are written ``&amp;`` and ``&lt;`` (and ``>`` ``&gt;`` in
roles), so no text can contain a control string and the original comes back exactly.

Defined results: a null text or role counts as empty; turns order by (turn, role, text) with nulls
first, so ties and repeated rows have one order; a null ``conv_id`` is a conversation of its own;
an empty table gives an empty result; other columns are ignored.  ``loss_spans`` are 0-based code
point offsets into ``formatted``, one span for each turn of ``loss_role``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_OPEN, TURN_CLOSE, NEXT = "<turn:", "</turn>\n", "<next/>\n"


def escape_text(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape_text(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape_text(c), F.lit(">"), F.lit("&gt;"))


def unescape_role(c: Column) -> Column:
    return unescape_text(F.replace(c, F.lit("&gt;"), F.lit(">")))


_BLOCKS = "array<struct<role:string,texts:array<string>>>"
_SPANS = "array<struct<start:bigint,length:bigint>>"


def _merged(turns: Column) -> Column:
    """Blocks, array<struct<role, texts>>, of adjacent turns of one role of a sorted array of turns."""
    start = F.struct(F.array().cast(_BLOCKS).alias("done"), F.lit(None).cast("string").alias("role"),
                     F.array().cast("array<string>").alias("texts"))

    def closed(acc):
        return F.concat(acc["done"], F.array(F.struct(acc["role"].alias("role"), acc["texts"].alias("texts"))))

    def take(acc, turn):
        same = acc["role"] == turn["role"]  # null before the first turn
        return F.struct(
            F.when(acc["role"].isNull() | same, acc["done"]).otherwise(closed(acc)).cast(_BLOCKS).alias("done"),
            turn["role"].alias("role"),
            F.when(same, F.concat(acc["texts"], F.array(turn["text"]))).otherwise(F.array(turn["text"])).cast("array<string>").alias("texts"))

    return F.aggregate(turns, start, take, closed)


def _spans(blocks: Column, loss_role: str) -> Column:
    """Where the texts of the blocks of ``loss_role`` stand in the concatenation of all blocks."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("spans"))

    def text(acc, body):
        size = F.length(body).cast("bigint")
        span = F.array(F.struct(acc["at"].alias("start"), size.alias("length")))
        return F.struct((acc["at"] + size + F.lit(len(NEXT))).cast("bigint").alias("at"), F.concat(acc["spans"], span).cast(_SPANS).alias("spans"))

    def block(acc, b):
        inside = F.aggregate(b["bodies"], F.struct((acc["at"] + F.length(b["head"])).cast("bigint").alias("at"), acc["spans"].alias("spans")), text)
        return F.struct((acc["at"] + F.length(b["piece"])).cast("bigint").alias("at"),
                        F.when(b["role"] == F.lit(loss_role), inside["spans"]).otherwise(acc["spans"]).cast(_SPANS).alias("spans"))

    return F.aggregate(blocks, start, block, lambda acc: acc["spans"])


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start, length>>: one row for each conversation."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))

    def written(b):
        head = F.concat(F.lit(TURN_OPEN), escape_role(b["role"]), F.lit(">\n"))
        return F.struct(b["role"].alias("role"), head.alias("head"), F.transform(b["texts"], escape_text).alias("bodies"))

    def whole(b):
        piece = F.concat(b["head"], F.array_join(b["bodies"], NEXT), F.lit(TURN_CLOSE))
        return F.struct(b["role"].alias("role"), b["head"].alias("head"), b["bodies"].alias("bodies"), piece.alias("piece"))

    blocks = grouped.select("conv_id", F.transform(F.transform(_merged(F.col("t")), written), whole).alias("blocks"))
    return blocks.select("conv_id", F.array_join(F.transform("blocks", lambda b: b["piece"]), "").alias("formatted"),
                         _spans(F.col("blocks"), loss_role).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, from a formatted conversation."""
    blocks = F.filter(F.split(formatted, "</turn>\n"), lambda b: b != F.lit(""))

    def turns_of(block: Column) -> Column:
        header_end = F.locate(">\n", block)
        role = unescape_role(F.substring(block, F.lit(len(TURN_OPEN) + 1), header_end - F.lit(len(TURN_OPEN) + 1)))
        texts = F.split(F.substring(block, header_end + F.lit(2), F.length(block)), "<next/>\n")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape_text(x).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape_text(
        F.substring(formatted, (s["start"] + F.lit(1)).cast("int"), s["length"].cast("int")))), "")
