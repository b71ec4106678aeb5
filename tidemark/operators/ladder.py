"""The return ladder: every horizon's return for every (ticker, session), computed once.

Returns depend on the ticker and the entry session, not on the event. So the horizons are laid
out over the price table, inside one partitioning by ticker, and events pick their row with a
single equi-join. A ticker holds at most one price per session, so a partition of the ladder is
bounded by the calendar however many events name that ticker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.returns import simple_return
from tidemark.operators.joins import splittable_join


def daily_prices(prices: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Price rows of the named tickers, in the contract's columns."""
    if "volume" not in prices.columns:
        prices = prices.withColumn("volume", F.lit(None).cast("double"))
    if "open" not in prices.columns:
        prices = prices.withColumn("open", F.lit(None).cast("double"))
    typed = prices.select(
        "ticker",
        F.col("date").cast("date").alias("date"),
        F.col("open").cast("double").alias("open"),
        F.col("close").cast("double").alias("close"),
        F.col("volume").cast("double").alias("volume"),
    )
    return typed if tickers is None else splittable_join(typed, tickers, "ticker", "left_semi")


def session_prices(prices: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per (ticker, t). Of repeated keys the row with the lowest close, open and volume stays
    whole; rows without a close come last. Combined map-side."""
    fields = ("close", "open", "volume")
    row = F.struct(F.col("close").isNull().alias("unpriced"), *fields)
    unique = daily_prices(prices).groupBy("ticker", "date").agg(F.min(row).alias("row"))
    unique = unique.select("ticker", "date", *[F.col(f"row.{c}").alias(c) for c in fields])
    return unique.join(F.broadcast(sessions), F.col("date") == F.col("cal_date")).select(
        "ticker", F.col("t").cast("long").alias("t"), "close", "open", "volume", "cal_date"
    )


def exact_ahead(value: str, steps: int) -> Column:
    """The ticker's value exactly ``steps`` sessions later, or null if it did not trade then."""
    at = Window.partitionBy("ticker").orderBy("t").rangeBetween(steps, steps)
    return F.max(value).over(at)


def exit_prices(px: DataFrame, horizons: dict[str, int]) -> DataFrame:
    return px.withColumns({f"exit_{h}": exact_ahead("close", n) for h, n in horizons.items()})


def delisting_history(delistings: DataFrame) -> DataFrame:
    """(ticker, history): a ticker's delistings in date order, one a day with its lowest recovery.

    Tickers are used again, so there may be several; each is a listing's end, so they are few.
    """
    daily = delistings.groupBy("ticker", F.col("delist_date").cast("date").alias("delist_date")).agg(
        F.min(F.coalesce("recovery_value", F.lit(0.0))).alias("recovery_value")
    )
    dated = daily.filter(F.col("delist_date").isNotNull())
    return dated.groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.struct("delist_date", "recovery_value"))).alias("history")
    )


def next_delisting(day: Column) -> Column:
    """The first delisting after a day, or null."""
    return F.get(F.filter("history", lambda d: d["delist_date"] > day), F.lit(0))


def last_delisting(day: Column) -> Column:
    """The latest delisting on or before a day, or null."""
    return F.try_element_at(F.filter("history", lambda d: d["delist_date"] <= day), F.lit(-1))


def return_ladder(
    prices: DataFrame,
    sessions: DataFrame,
    horizons: dict[str, int],
    delistings: DataFrame | None = None,
    exit_dates: DataFrame | None = None,
    entry_field: str = "close",
    features: dict[str, Column] | None = None,
) -> DataFrame:
    """(ticker, entry_t, entry_close, ret_<h>…), with delistings booked where they are known.

    ``features`` are further expressions over the session prices, such as windows by ticker;
    they share the ladder's partitioning.
    """
    features = features or {}
    px = exit_prices(session_prices(prices, sessions), horizons).withColumns(features)
    returns = {h: simple_return(F.col(entry_field), F.col(f"exit_{h}")) for h in horizons}
    if delistings is not None:
        px = px.join(exit_dates, "t").join(delisting_history(delistings), "ticker", "left")
        px = px.withColumn("end", next_delisting(F.col("cal_date")))
        for h in horizons:
            gone = F.col("end.delist_date") <= F.col(f"exit_date_{h}")
            booked = simple_return(F.col(entry_field), F.col("end.recovery_value"))
            returns[h] = F.when(gone, booked).otherwise(returns[h])
    return px.select(
        "ticker",
        F.col("t").alias("entry_t"),
        F.col(entry_field).alias("entry_close"),
        *[returns[h].alias(f"ret_{h}") for h in horizons],
        *features,
    )
