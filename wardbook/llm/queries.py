"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from wardbook.llm import (
    alignment,
    encoding,
    exact,
    language,
    licences,
    packing,
    pages,
    passages,
    phrases,
    simhash,
    substrings,
    toxicity,
    vectors,
)

QUERIES = {
    "op1_near_vectors": vectors.op1_near_vectors,
    "op2_packing": packing.op2_packing,
    "op3_exact_dedup": exact.op3_exact_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_suffix_dedup": substrings.op5_suffix_dedup,
    "op6_licences": licences.op6_licences,
    "op7_byte_bpe": encoding.op7_byte_bpe,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_language": language.op9_language,
    "op10_passages": passages.op10_passages,
    "op11_main_text": pages.op11_main_text,
    "op12_phrases": phrases.op12_phrases,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE_SQL = {
    "op1_near_vectors": vectors.SQL,
    "op3_exact_dedup": exact.SQL,
    "op5_suffix_dedup": substrings.SQL,
    "op6_licences": licences.SQL,
    "op10_passages": passages.SQL,
    "op12_phrases": phrases.SQL,
}
