"""All queries over the supplied tables, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.plans import classify, duplicates, endpoints, labels, runs, settings, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**duplicates.QUERIES, **labels.QUERIES, **classify.QUERIES, **runs.QUERIES, **streams.QUERIES, **endpoints.QUERIES, **settings.QUERIES}
SQL: dict[str, str] = {**duplicates.SQL, **labels.SQL, **classify.SQL, **runs.SQL, **streams.SQL, **endpoints.SQL, **settings.SQL}
