"""Queries and SQL of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from . import decontam, digest_index, fertility, fim, langid, mixing, near_dup, pii, quality, substring, token_counts, warc, whitening
from .shared import Query

QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": near_dup.op1_minhash_near_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_quality_rules": fertility.op5_quality_rules,
    "op6_pii": pii.op6_pii,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_warc": warc.op8_warc,
    "op9_language_id": langid.op9_language_id,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_exact_dedup": digest_index.op13_exact_dedup,
}

#: Models and tokenizer files (2, 5, 6, 9, 10, 12) are beyond SQL; tests hold them against brute force.
SQL: dict[str, str] = {
    "op1_minhash_near_dedup": near_dup.OP1_SQL,
    "op3_source_mixing": mixing.OP3_SQL,
    "op4_substring_dedup": substring.OP4_SQL,
    "op7_decontamination": decontam.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op13_exact_dedup": digest_index.OP13_SQL,
}
