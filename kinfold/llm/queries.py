"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, exact_dedup, licenses, packing, quality, simhash, substrings, topk, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_simhash": simhash.op2_simhash,
    "op3_substrings": substrings.op3_substrings,
    "op4_bpe": bpe.op4_bpe,
    "op5_packing": packing.op5_packing,
    "op6_licenses": licenses.op6_licenses,
    "op7_topk": topk.op7_topk,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_quality": quality.op9_quality,
    "op10_chat": chat.op10_chat,
}

SQL = {
    "op3_substrings": substrings.OP3_SQL,
    "op6_licenses": licenses.OP6_SQL,
    "op7_topk": topk.OP7_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op10_chat": chat.OP10_SQL,
}
