"""Queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import mixing, packing, quality, sharding, simhash, span_dedup, suffix_dedup, token_files, topk, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_exact_topk": topk.op2_exact_topk,
    "op3_temperature_mix": mixing.op3_temperature_mix,
    "op4_token_files": token_files.op4_token_files,
    "op5_balanced_shards": sharding.op5_balanced_shards,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_sentence_spans": span_dedup.op7_sentence_spans,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_simhash": simhash.op10_simhash,
}

ORACLE_SQL = {
    "op2_exact_topk": topk.ORACLE,
    "op3_temperature_mix": mixing.ORACLE,
    "op6_suffix_dedup": suffix_dedup.ORACLE,
    "op9_quality_rules": quality.ORACLE,
}
