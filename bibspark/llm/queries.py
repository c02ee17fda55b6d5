"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import bpe, context_mixing, decontaminate, exact_dedup, html_extract, jaccard_join, kd_shards, lexical_search, packing, secrets, suffix_dedup, toxicity, whitening

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_secrets": secrets.op6_secrets,
    "op7_kd_shards": kd_shards.op7_kd_shards,
    "op8_context_mixing": context_mixing.op8_context_mixing,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_packing": packing.op12_packing,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {
    "op1_html_extract": html_extract.OP1_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op11_lexical_search": lexical_search.OP11_SQL,
}
