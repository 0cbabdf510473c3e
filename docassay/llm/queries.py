"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from docassay.llm import (
    ann, chat, decontam, divergence, langid, linededup, mixing, neardup, pii, quality, secretscan, spelling, toxicity,
)

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_near_duplicates": neardup.op4_near_duplicates,
    "op5_personal_data": pii.op5_personal_data,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_language_id": langid.op7_language_id,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_nearest_neighbours": ann.op9_nearest_neighbours,
    "op10_quality": quality.op10_quality,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_secret_scan": secretscan.op13_secret_scan,
}

SQL = {
    "op1_line_dedup": linededup.SQL,
    "op2_mix_sources": mixing.SQL,
    "op3_chat_formatting": chat.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_secret_scan": secretscan.SQL,
}
