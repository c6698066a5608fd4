"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pagelens.llm import ann, automaton, bpe, html_main, mixing, ngram_join, pii, quality, secrets, suffix_levels

QUERIES = {
    "op1_source_mix": mixing.op1_source_mix,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_html_main_text": html_main.op4_html_main_text,
    "op5_automaton_dedup": automaton.op5_automaton_dedup,
    "op6_personal_data": pii.op6_personal_data,
    "op7_suffix_levels": suffix_levels.op7_suffix_levels,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_permutation_neighbours": ann.op9_permutation_neighbours,
    "op10_quality_rules": quality.op10_quality_rules,
}
ORACLE_SQL = {
    "op1_source_mix": mixing.OP1_SQL,
    "op5_automaton_dedup": automaton.OP5_SQL,
    "op7_suffix_levels": suffix_levels.OP7_SQL,
    "op8_secret_scan": secrets.OP8_SQL,
}
