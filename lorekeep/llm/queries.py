"""Registry of the queries of this subpackage and of their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query and the module that has it.
_OPERATORS = {
    "op1_fingerprints": "fingerprints",
    "op2_suffix_array_dedup": "suffix_dedup",
    "op3_html_extraction": "html_extraction",
    "op4_line_dedup": "line_dedup",
    "op5_source_mixing": "source_mixing",
    "op6_language_id": "language_id",
    "op7_quality_rules": "quality_rules",
    "op8_bpe_codec": "bpe_codec",
    "op9_url_filters": "url_filters",
    "op10_ngram_jaccard_join": "shingle_join",
    "op11_embedding_whitening": "embedding_whitening",
    "op12_filter_audit": "filter_audit",
    "op13_toxicity": "toxicity",
}

#: Those whose module has ``oracle()``.
_WITH_SQL = ("op5_source_mixing", "op9_url_filters", "op12_filter_audit")


def _lazy(module: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(importlib.import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    query.__name__ = name
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _lazy(module, name) for name, module in _OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: importlib.import_module(f"{__package__}.{_OPERATORS[name]}").oracle() for name in _WITH_SQL}
