"""All queries of the library by name, with the SQL that an independent engine runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import corpus, files, measures, parts, passages, places, retrieval, routing, search, streams

_PLANS = (search, corpus, places, measures, routing, streams, retrieval, passages, parts, files)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for plan in _PLANS for k, f in plan.QUERIES.items()}
ORACLES: dict[str, str] = {k: sql for plan in _PLANS for k, sql in plan.ORACLES.items()}
