"""Registered queries of the training-data operators and their DuckDB SQL.

Operators without an entry in ``ORACLE_SQL`` are not expressible in SQL; their
tests compare them with a brute-force version.
"""

from __future__ import annotations

from tillcast.llm import (bpe, decontaminate, merkle, quality_classifier, quality_rules, secret_scan, sharding, simhash, suffix_dedup,
                          token_counts, token_files, toxicity, whitening)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_bpe": bpe.op4_bpe,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_simhash": simhash.op7_simhash,
    "op8_token_files": token_files.op8_token_files,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_sharding": sharding.op10_sharding,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_secret_scan": secret_scan.op12_secret_scan,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.oracle_sql(),
    "op5_suffix_dedup": suffix_dedup.oracle_sql(),
    "op6_decontamination": decontaminate.oracle_sql(),
    "op11_merkle_manifest": merkle.oracle_sql(),
}
