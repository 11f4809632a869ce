"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from . import conversations, decontaminate, fingerprints, html_text, importance, jaccard_join, language_id, minhash, quality, source_mix, suffix_dedup, token_counts, url_filter

QUERIES = {
    "op1_quality": quality.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_source_mix": source_mix.query,
    "op4_jaccard_join": jaccard_join.query,
    "op5_url_filter": url_filter.query,
    "op6_language_id": language_id.query,
    "op7_html_text": html_text.query,
    "op8_decontaminate": decontaminate.query,
    "op9_fingerprints": fingerprints.query,
    "op10_token_counts": token_counts.query,
    "op11_minhash": minhash.query,
    "op12_importance": importance.query,
    "op13_conversations": conversations.query,
}

ORACLES = {
    "op2_suffix_dedup": suffix_dedup.ORACLE,
    "op3_source_mix": source_mix.ORACLE,
    "op4_jaccard_join": jaccard_join.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op11_minhash": minhash.ORACLE,
    "op12_importance": importance.ORACLE,
    "op13_conversations": conversations.ORACLE,
}
