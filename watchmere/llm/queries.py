"""The named queries of this package and their DuckDB SQL."""

from __future__ import annotations

from watchmere.llm import bpe, chat_format, decontaminate, license_scan, line_dedup, near_duplicates, periodic_runs, phrase_mining, pii, quality, secrets, suffix_dedup, url_filter

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_bpe": bpe.op3_bpe,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_jaccard_join": near_duplicates.op6_jaccard_join,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_pii": pii.op9_pii,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_phrase_mining": phrase_mining.op12_phrase_mining,
    "op13_url_filter": url_filter.op13_url_filter,
}

ORACLES = {
    "op10_decontaminate": decontaminate.ORACLE,
    "op12_phrase_mining": phrase_mining.ORACLE,
}
