"""The queries opN_<name> of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from foliant.llm import chat_format, exact_dedup, html_text, lm_score, near_dup, packing, pieces, quality, shards, token_files

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_near_dup": near_dup.op3_near_dup,
    "op4_html_text": html_text.op4_html_text,
    "op5_token_files": token_files.op5_token_files,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_sharding": shards.op9_sharding,
    "op10_pieces": pieces.op10_pieces,
}
ORACLE_SQL = {
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op7_chat_format": chat_format.OP7_SQL,
}
