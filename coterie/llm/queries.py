"""The queries of this subpackage, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from coterie.llm.byte_bpe import op6_byte_bpe
from coterie.llm.language import op5_language
from coterie.llm.mixing import ORACLE_OP2, op2_mixing
from coterie.llm.quality import op7_quality_rules
from coterie.llm.simhash import op8_simhash
from coterie.llm.substrings import ORACLE_OP4, op4_substrings
from coterie.llm.suffix_dedup import ORACLE_OP1, op1_suffix_dedup
from coterie.llm.topk import ORACLE_OP10, op10_topk
from coterie.llm.toxicity import op9_toxicity
from coterie.llm.urls import ORACLE_OP3, op3_url_filter

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mixing": op2_mixing,
    "op3_url_filter": op3_url_filter,
    "op4_substrings": op4_substrings,
    "op5_language": op5_language,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_topk": op10_topk,
}

ORACLE: dict[str, str] = {
    "op1_suffix_dedup": ORACLE_OP1,
    "op2_mixing": ORACLE_OP2,
    "op3_url_filter": ORACLE_OP3,
    "op4_substrings": ORACLE_OP4,
    "op10_topk": ORACLE_OP10,
}
