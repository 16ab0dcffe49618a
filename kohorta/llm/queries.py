"""Queries of this subpackage and their reference SQL, by registered name."""

from __future__ import annotations

from kohorta.llm import (
    collocations,
    cross_entropy,
    decontaminate,
    html_text,
    jaccard,
    line_dedup,
    mixing,
    periodic_runs,
    quality,
    substring_dedup,
    suffix_dedup,
    tokens,
    toxicity,
)
from kohorta.session import tune

_QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_html_text": html_text.query,
    "op3_token_planes": tokens.query,
    "op4_cross_entropy": cross_entropy.query,
    "op5_toxicity": toxicity.query,
    "op6_mix_sources": mixing.query,
    "op7_quality_rules": quality.query,
    "op8_decontaminate": decontaminate.query,
    "op9_line_dedup": line_dedup.query,
    "op10_jaccard_join": jaccard.query,
    "op11_substring_dedup": substring_dedup.query,
    "op12_collocations": collocations.query,
    "op13_periodic_runs": periodic_runs.query,
}


def _tuned(query):
    return lambda spark, folder: query(tune(spark), folder)


def registered() -> dict:
    return {name: _tuned(query) for name, query in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_cross_entropy": cross_entropy.SQL,
        "op6_mix_sources": mixing.SQL,
        "op8_decontaminate": decontaminate.SQL,
        "op9_line_dedup": line_dedup.SQL,
        "op11_substring_dedup": substring_dedup.SQL,
        "op12_collocations": collocations.SQL,
    }
