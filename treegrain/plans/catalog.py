"""All queries over the driver's tables, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treegrain.plans import accounts, corpus, ingest, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**search.QUERIES, **corpus.QUERIES, **accounts.QUERIES, **ingest.QUERIES}
ORACLE_SQL: dict[str, str] = {**search.ORACLE_SQL, **corpus.ORACLE_SQL, **accounts.ORACLE_SQL, **ingest.ORACLE_SQL}
