"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import archives, decontamination, filter_audit, lexical_search, media, mixing, quality, sharding, simhash, suffix_dedup, token_counts, toxicity, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1,
    "op2_warc": archives.op2,
    "op3_suffix_dedup": suffix_dedup.op3,
    "op4_simhash": simhash.op4,
    "op5_media": media.op5,
    "op6_sharding": sharding.op6,
    "op7_toxicity": toxicity.op7,
    "op8_quality": quality.op8,
    "op9_decontamination": decontamination.op9,
    "op10_mixing": mixing.op10,
    "op11_lexical_search": lexical_search.op11,
    "op12_filter_audit": filter_audit.op12,
    "op13_token_counts": token_counts.op13,
}

SQL = {"op1_url_filters": url_filters.SQL, "op2_warc": archives.SQL, "op9_decontamination": decontamination.SQL, "op11_lexical_search": lexical_search.SQL, "op12_filter_audit": filter_audit.SQL}
