"""Price tables: the contract, its window, and reshaping of wide downloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import signals
from tidemark.operators.ladder import daily_prices

# Days of prices a study needs after its last filing.
FORWARD_DAYS = 420


def daily_closes(
    prices: DataFrame, tickers: DataFrame, start: Column, end: Column
) -> DataFrame:
    """[ticker, date, open, close, volume] of the requested tickers within [start, end]."""
    wanted = signals.requestable_tickers(tickers)
    inside = prices.filter(F.col("date").between(start, end))
    return daily_prices(inside, wanted)


def study_window(events: DataFrame) -> tuple[Column, Column]:
    """First filing date, and the last one plus the forward allowance, as scalar subqueries."""
    first = events.agg(F.min("filing_date")).scalar()
    last = events.agg(F.date_add(F.max("filing_date"), FORWARD_DAYS)).scalar()
    return first, last


def wide_to_long(
    wide: DataFrame, tickers: Sequence[str], date: str = "date", separator: str = "_"
) -> DataFrame:
    """Columns ``<ticker>_open`` / ``<ticker>_close`` to [ticker, date, open, close].

    Tickers without a close column are skipped, rows without a close are dropped.
    """
    present = [t for t in tickers if f"{t}{separator}close" in wide.columns]
    if not present:
        return wide.sparkSession.createDataFrame(
            [], "ticker string, date date, open double, close double"
        )

    def field(ticker: str, name: str) -> Column:
        column = f"{ticker}{separator}{name}"
        known = F.col(f"`{column}`") if column in wide.columns else F.lit(None)
        return known.cast("double").alias(name)

    cells = F.array(
        *[
            F.struct(F.lit(t).alias("ticker"), field(t, "open"), field(t, "close"))
            for t in present
        ]
    )
    return (
        wide.select(F.col(date).cast("date").alias("date"), F.inline(cells))
        .filter(F.col("close").isNotNull())
        .select("ticker", "date", "open", "close")
    )
