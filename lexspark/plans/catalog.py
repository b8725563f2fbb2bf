"""All queries of the library: name to function of (spark, sf_dir), and name to SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexspark.plans import carrier_queries, chunk_queries, corpus_queries, curation_queries, decision_queries, exchange_queries, gloss_queries, grading_queries, level_queries, lexicon_queries, log_queries, paradigm_queries, parse_queries, pattern_queries, session_queries, unit_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (corpus_queries, log_queries, unit_queries, grading_queries, gloss_queries, decision_queries, pattern_queries, session_queries, curation_queries, level_queries, parse_queries, lexicon_queries, paradigm_queries, exchange_queries, chunk_queries, carrier_queries)


def _merged(tables: list[dict]) -> dict:
    """One table of all; a name that two modules have is an error, since one of them would be lost."""
    merged: dict = {}
    for table in tables:
        if twice := merged.keys() & table.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        merged |= table
    return merged


QUERIES: dict[str, Query] = _merged([m.QUERIES for m in MODULES])
ORACLES: dict[str, str] = _merged([m.ORACLES for m in MODULES])
if lost := ORACLES.keys() - QUERIES.keys():
    raise ValueError(f"SQL without a query: {sorted(lost)}")
