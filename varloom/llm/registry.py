"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from varloom.llm import collocations, embedding_dedup, filter_audit, line_dedup, mixing, near_dedup, ngram_lm, pieces, quality_rules, rule_ensemble, secrets, sharding, url_filter

QUERIES = {
    "op1_lm_scoring": ngram_lm.op1_lm_scoring,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_embedding_near_dedup": embedding_dedup.op4_embedding_near_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_secret_scans": secrets.op7_secret_scans,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality_classifier": rule_ensemble.op9_quality_classifier,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
    "op13_url_filter": url_filter.op13_url_filter,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op3_quality_rules": quality_rules.ORACLE, "op11_filter_audit": filter_audit.ORACLE, "op12_phrase_collocations": collocations.ORACLE, "op13_url_filter": url_filter.ORACLE}
