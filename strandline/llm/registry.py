"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import boosted_quality, byte_bpe, chat_format, importance, license_scan, ngram_join, packing, quality_rules, run_collapse, substring_dedup, telephony, token_archive, token_counts

_MODULES = [telephony, token_archive, license_scan, quality_rules, substring_dedup, packing, token_counts, byte_bpe, chat_format, ngram_join, run_collapse, importance, boosted_quality]


def queries() -> dict:
    out = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    out = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
