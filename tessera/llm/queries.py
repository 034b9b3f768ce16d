"""The operators and the pipeline as queries over the tables of a folder."""

from __future__ import annotations

import importlib.util

from ..registry import importable
from . import alignment, decontaminate, html, jaccard, mixing, periodic, pii, quality, sharding, substrings, token_counts, tokens, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_html_text": html.op4_html_text,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_pii": pii.op7_pii,
    "op8_repeated_substrings": substrings.op8_repeated_substrings,
    "op9_token_ids": tokens.op9_token_ids,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_alignment": alignment.op11_alignment,
    "op12_sharding": sharding.op12_sharding,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

SQL = {
    "op2_mix_sources": mixing.SQL,
    "op3_jaccard_join": jaccard.SQL,
    "op5_quality_rules": quality.SQL,
    "op6_decontaminate": decontaminate.SQL,
}


def pipeline(spark, sf_dir: str):
    """All stages of the pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _run(f):
    def run(spark, sf_dir: str):
        importable(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict:
    out = {name: _run(f) for name, f in QUERIES.items()}
    if importlib.util.find_spec("corpus_pipeline") is not None:
        out["pipeline"] = _run(pipeline)
    return out


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
