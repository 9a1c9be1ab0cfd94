"""Queries over the driver's tables, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslake.plans import cards, corpus, dialogue, more, retrieval, rules, scenes, sources

_MODULES = (corpus, dialogue, retrieval, cards, more, sources, scenes, rules)
QUERIES = {name: f for m in _MODULES for name, f in m.Q.queries.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.Q.oracles.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents normalised, deduplicated, filtered and split without leaks; counts by split."""
    return QUERIES["split_manifest"](spark, sf_dir)
