"""op2: packing of all documents."""

from __future__ import annotations

from postmetrics.llm import packing
from postmetrics.llm.registry import register, table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op2_packing")
def op2_packing(spark, sf_dir):
    """Every piece of every document with its place in a sequence of at most 1024 tokens."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
