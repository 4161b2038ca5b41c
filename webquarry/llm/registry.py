"""Queries of the training-data operators, one per operator, with oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from webquarry.llm import (
    bpe_prefix,
    crf_extract,
    decontaminate,
    hilbert_shards,
    icws_dedup,
    language_fusion,
    licence_digests,
    ngram_quality,
    periodic_runs,
    source_mixture,
    substring_dedup,
    url_digests,
    vector_codes,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for module in (hilbert_shards, licence_digests, ngram_quality, language_fusion, icws_dedup, substring_dedup, crf_extract, bpe_prefix, url_digests, decontaminate, periodic_runs, source_mixture, vector_codes):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
