"""All queries of the subpackage: importing this module registers them."""

from postmetrics.llm import q_chat, q_context_tree, q_line_dedup, q_minhash, q_mining, q_mtree, q_packing, q_projections, q_pu_quality, q_repair, q_sentencepieces, q_suffix_dedup, q_toxicity  # noqa: F401
from postmetrics.llm.registry import ORACLE, QUERIES  # noqa: F401
