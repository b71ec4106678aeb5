"""The abnormal-return panel: one row per event, two columns per horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ladder, sessions
from tidemark.schemas import HORIZONS


def abnormal_returns(
    events: DataFrame,
    prices: DataFrame,
    benchmark: DataFrame,
    calendar: DataFrame | None = None,
    horizons: dict[str, int] | None = None,
    delistings: DataFrame | None = None,
    entry_field: str = "close",
    entry_lag: int = 0,
    carry: Sequence[str] = (),
    price_features: dict[str, Column] | None = None,
) -> DataFrame:
    """Forward and benchmark-adjusted returns, indexed off the filing date.

    Entry is the first session on or after the filing date (plus ``entry_lag`` sessions), exit
    is that many sessions later. Events without a price stay, unpriced. Every event is
    shuffled once, for the ladder lookup; ``carry`` names event columns (or ``entry_t``) to keep
    beside it, which spares a later join back. ``price_features`` are expressions over the price
    table, read at the entry session through the same lookup as the returns.
    """
    horizons = horizons or HORIZONS
    numbered = sessions.numbered_sessions(
        sessions.trading_calendar(benchmark) if calendar is None else calendar
    )
    entries = sessions.entry_calendar(numbered, benchmark, horizons, entry_lag, entry_field)
    exit_dates = None
    if delistings is not None:
        exit_dates = F.broadcast(
            sessions.entry_calendar(numbered, benchmark, horizons)
            .filter(F.col("day") == F.col("entry_date"))
            .select(
                F.col("entry_t").cast("long").alias("t"),
                *[f"exit_date_{h}" for h in horizons],
            )
        )
    steps = ladder.return_ladder(
        prices, numbered, horizons, delistings, exit_dates, entry_field, price_features
    )
    placed = sessions.with_entry(
        events.select(
            "accession", "txn_sk", "ticker",
            F.col("filing_date").cast("date").alias("filing_date"),
            *[c for c in carry if c != "entry_t"],
        ),
        numbered,
        entries.drop(*[f"exit_date_{h}" for h in horizons]),
    ).withColumn("entry_t", F.col("entry_t").cast("long"))
    return placed.join(steps, ["ticker", "entry_t"], "left").select(
        "accession",
        "txn_sk",
        "ticker",
        "filing_date",
        "entry_date",
        "entry_close",
        F.col("entry_close").isNotNull().alias("priced"),
        *[f"ret_{h}" for h in horizons],
        *[(F.col(f"ret_{h}") - F.col(f"bench_ret_{h}")).alias(f"abn_{h}") for h in horizons],
        *carry,
        *(price_features or {}),
    )
