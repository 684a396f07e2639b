"""All queries over the driver tables by name, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import analytics, contracts, knowledge, similarity, texts

_PARTS = (similarity, texts, knowledge, contracts, analytics)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for part in _PARTS for k, q in part.ORACLES.items()}
