"""From raw filing tables to the canonical event table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tidemark.functions import signals
from tidemark.operators import collapse, flatten
from tidemark.sources import store


def normalize(flat: DataFrame, footnotes: DataFrame | None = None) -> DataFrame:
    """Typed, collapsed events from flattened purchase rows."""
    typed = flatten.typed_rows(flat)
    if footnotes is not None:
        typed = collapse.with_footnote_plans(typed, footnotes)
    return collapse.collapse_cofilers(typed)


def purchase_events(
    submissions: DataFrame,
    owners: DataFrame,
    transactions: DataFrame,
    footnotes: DataFrame | None = None,
    document_types: Iterable[str] = ("4",),
    colocated: bool = False,
) -> DataFrame:
    """The same events as ``normalize(flatten_purchases(...))``, planned trades included.

    Each input is collapsed before the join, so the work is linear in the inputs however many
    owners and transactions one filing holds. ``colocated`` says that the three tables are bucketed by accession.
    """
    filings = flatten.typed_filings(flatten.purchase_filings(submissions, document_types))
    trades = flatten.typed_trades(flatten.purchase_trades(transactions))
    return collapse.assemble_events(filings, flatten.owner_columns(owners), trades, footnotes, colocated)


def build_events(
    submissions: DataFrame,
    owners: DataFrame,
    transactions: DataFrame,
    footnotes: DataFrame | None = None,
    document_types: Iterable[str] = ("4",),
    out_path: str | None = None,
) -> DataFrame:
    """Qualifying events: planned trades dropped, optionally written as Parquet by year."""
    events = signals.drop_planned(
        purchase_events(submissions, owners, transactions, footnotes, document_types)
    )
    if out_path is None:
        return events
    store.write_events(events, out_path)
    return store.read_table(events.sparkSession, out_path).select(*events.columns)
