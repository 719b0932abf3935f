"""The registered queries of this package and their SQL."""

from __future__ import annotations

from rollbook.llm import bpe, filter_audit, merkle, minhash, mixing, mtree, quality_mil, quality_rules, secret_scan, token_codec, token_counts, toxicity, url_filter

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_quality_mil": quality_mil.op2_quality_mil,
    "op3_minhash": minhash.op3_minhash,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_token_codec": token_codec.op5_token_codec,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_mixing": mixing.op7_mixing,
    "op8_bpe": bpe.op8_bpe,
    "op9_mtree": mtree.op9_mtree,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_url_filter": url_filter.op11_url_filter,
    "op12_merkle": merkle.op12_merkle,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLE_SQL = {**quality_rules.ORACLE_SQL, **mixing.ORACLE_SQL, **mtree.ORACLE_SQL, **url_filter.ORACLE_SQL, **merkle.ORACLE_SQL, **filter_audit.ORACLE_SQL}
