"""Queries of the subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from sievework.llm.byte_bpe import op6_byte_bpe
from sievework.llm.collocations import SQL_OP13, op13_collocations
from sievework.llm.decontaminate import SQL_OP9, op9_decontaminate
from sievework.llm.language_id import op1_language_id
from sievework.llm.license_scan import op5_license_scan, sql_op5
from sievework.llm.lm_scoring import op8_lm_scoring
from sievework.llm.near_dedup import op4_near_dedup
from sievework.llm.paragraph_dedup import op2_paragraph_dedup
from sievework.llm.quality_rules import SQL_OP3, op3_quality_rules
from sievework.llm.source_divergence import SQL_OP11, op11_source_divergence
from sievework.llm.token_counts import op10_token_counts
from sievework.llm.token_tables import op7_token_tables
from sievework.llm.toxicity import op12_toxicity

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_paragraph_dedup": op2_paragraph_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_near_dedup": op4_near_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_token_tables": op7_token_tables,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_counts": op10_token_counts,
    "op11_source_divergence": op11_source_divergence,
    "op12_toxicity": op12_toxicity,
    "op13_collocations": op13_collocations,
}

SQL: dict[str, str] = {
    "op3_quality_rules": SQL_OP3,
    "op5_license_scan": sql_op5(),
    "op9_decontaminate": SQL_OP9,
    "op11_source_divergence": SQL_OP11,
    "op13_collocations": SQL_OP13,
}
