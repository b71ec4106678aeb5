"""How the queries of this subpackage are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.session import table, tune_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, source: str, sql: str | None = None):
    """Register a job over one whole table, with its SQL twin where SQL can express it."""

    def register(job: Callable[[DataFrame, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return job(table(tune_text(spark), folder, source), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return job

    return register
