"""How queries are registered, and the table chains most of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.fixtures import Tables
from tidemark.functions import signals
from tidemark.operators import flatten
from tidemark.oracle import with_ctes
from tidemark.plans import events as event_plans
from tidemark.plans.panel import abnormal_returns
from tidemark.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, **ctes: str):
    """Register a job over the mapped tables, with its SQL twin where there is one."""

    def register(job: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return job(Tables(tune(spark), folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_ctes(sql, **ctes)
        return job

    return register


def r9(column: Column | str, name: str | None = None) -> Column:
    """Rounded so that two engines' summation orders agree."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, 9).alias(name or column)


def flat_rows(t: Tables, document_types=("4",)) -> DataFrame:
    return flatten.flatten_purchases(
        t.submissions(), t.owners(), t.transactions(), document_types
    )


def all_events(t: Tables) -> DataFrame:
    return event_plans.purchase_events(
        t.submissions(), t.owners(), t.transactions(), t.footnotes()
    )


def unplanned_events(t: Tables) -> DataFrame:
    return signals.drop_planned(all_events(t))


def study_events(t: Tables) -> DataFrame:
    return signals.eligible_events(unplanned_events(t))


def study_panel(t: Tables, **options) -> DataFrame:
    return abnormal_returns(study_events(t), t.prices(), t.benchmark(), **options)
