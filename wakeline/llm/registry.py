"""All queries and SQL of this subpackage."""

from __future__ import annotations

from wakeline.llm import decontamination, fingerprints, language_id, line_dedup, lm_scoring, ngram_join, packing, repeats, token_counts, token_output

MODULES = (token_output, repeats, fingerprints, decontamination, token_counts, language_id, ngram_join, line_dedup, lm_scoring, packing)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}
