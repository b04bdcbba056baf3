"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, chat_format, conversation_repair, filter_audit, fingerprints, licenses, mixing, near_dedup, neighbours, packing, quality, substring_dedup, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_licenses": licenses.op3_licenses,
    "op4_bpe": bpe.op4_bpe,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_neighbours": neighbours.op8_neighbours,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_quality": quality.op10_quality,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_packing": packing.op13_packing,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op5_chat_format": chat_format.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op9_near_dedup": near_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
