"""op9: SentencePiece encoding and decoding of all documents."""

from __future__ import annotations

from postmetrics.llm import sentencepieces
from postmetrics.llm.registry import register, table


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@register("op9_sentencepieces")
def op9_sentencepieces(spark, sf_dir):
    """Digests of the ids and of the decoded text of every whole document."""
    return sentencepieces.digest(table(spark, sf_dir, "documents"), model_file())
