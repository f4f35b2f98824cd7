"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, decontam, htmltext, infill, jaccard, licenses, lines, quality, rans, runs, toxicity, urls

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op4_chat_perspectives": chat.op4_chat_perspectives,
    "op5_url_filter": urls.op5_url_filter,
    "op6_bpe": bpe.op6_bpe,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_main_text": htmltext.op9_main_text,
    "op10_token_files": rans.op10_token_files,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_line_dedup": lines.op12_line_dedup,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}
ORACLES = {
    "op2_license_scan": licenses.oracle_sql,
    "op4_chat_perspectives": lambda: chat.ORACLE_SQL,
    "op12_line_dedup": lambda: lines.ORACLE_SQL,
    "op13_fill_in_middle": lambda: infill.ORACLE_SQL,
}
