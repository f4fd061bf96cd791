"""Queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from . import embedding_dups, jaccard, licenses, mixing, packing, pitman_yor, substrings, token_files, topk, toxicity

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_token_files": token_files.op2_token_files,
    "op3_mixing": mixing.op3_mixing,
    "op4_packing": packing.op4_packing,
    "op5_language_model": pitman_yor.op5_language_model,
    "op6_embedding_dups": embedding_dups.op6_embedding_dups,
    "op7_topk": topk.op7_topk,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_substrings": substrings.op9_substrings,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES = {
    "op1_licenses": licenses.OP1_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op6_embedding_dups": embedding_dups.OP6_SQL,
    "op7_topk": topk.OP7_SQL,
    "op8_jaccard_join": jaccard.OP8_SQL,
    "op9_substrings": substrings.OP9_SQL,
}
