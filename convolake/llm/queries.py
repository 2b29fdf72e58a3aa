"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from convolake.llm import bpe, collocations, dac, filter_audit, line_dedup, mixing, ngram_join, quality, quality_rules, sharding, simhash, threshold, toxicity

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_threshold": threshold.op2_threshold,
    "op3_mixing": mixing.op3_mixing,
    "op4_dac": dac.op4_dac,
    "op5_quality": quality.op5_quality,
    "op6_sharding": sharding.op6_sharding,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_simhash": simhash.op10_simhash,
    "op11_ngram_join": ngram_join.op11_ngram_join,
    "op12_collocations": collocations.op12_collocations,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op2_threshold": threshold.OP2_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
