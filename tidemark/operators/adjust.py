"""Prices adjusted for splits and dividends.

An action lowers all prices before its ex-date by one factor, and a price is multiplied by the factors of all actions after it. Days and actions
of a ticker meet in one partitioning, as rows of one course in time, so neither an as-of join nor a copy of a price per action is needed. Prices fold to
one row per ticker and day first, so a ticker's course is bounded by the calendar however often its rows are repeated, and pick up their day's factor by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ladder import daily_prices


def daily_actions(actions: DataFrame) -> DataFrame:
    """(ticker, date, split, dividend): splits of one day multiply, dividends add up, both nothing (1 and 0) where there is none.

    ``actions`` are (ticker, ex_date, split, dividend): new shares for an old one, and money per old share. Values that are null or not positive count as none; rows without ticker or
    ex-date are left out.
    """
    usable = actions.filter(F.col("ticker").isNotNull() & F.col("ex_date").isNotNull())
    return usable.groupBy("ticker", F.col("ex_date").cast("date").alias("date")).agg(
        F.coalesce(F.product(F.when(F.col("split") > 0, F.col("split").cast("double"))), F.lit(1.0)).alias("split"),
        F.coalesce(F.sum(F.when(F.col("dividend") > 0, F.col("dividend").cast("double"))), F.lit(0.0)).alias("dividend"),
    )


def _quoted(prices: DataFrame) -> DataFrame:
    return daily_prices(prices).filter(F.col("ticker").isNotNull() & F.col("date").isNotNull())


def _course(prices: DataFrame, actions: DataFrame) -> DataFrame:
    """Days with prints (the lowest close of each, as in the ladder) and actions as rows; an action knows the last close before its ex-date."""
    days = _quoted(prices).groupBy("ticker", "date").agg(F.min("close").alias("close")).withColumn("printed", F.lit(True))
    rows = days.unionByName(daily_actions(actions).withColumn("printed", F.lit(False)), allowMissingColumns=True)
    # An action comes before the prints of its own day.
    before = Window.partitionBy("ticker").orderBy("date", "printed").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("last_close", F.when(~F.col("printed"), F.last("close", ignorenulls=True).over(before)))


def _paid(dividend: Column, last_close: Column) -> Column:
    """What a dividend leaves of the last close; all of it where nothing was quoted before, or the dividend is not below it."""
    return F.when(dividend < last_close, 1 - dividend / last_close).otherwise(1.0)


def adjusted_prices(prices: DataFrame, actions: DataFrame, dividends: bool = True) -> DataFrame:
    """[ticker, date, open, close, volume, factor]: prices as a holder of today's shares would have seen them.

    A split of s divides earlier prices by s and multiplies earlier volumes; a dividend d multiplies earlier prices by 1 - d / (last close before it), so that returns are total returns
    (not with ``dividends=False``). An action without a print on its own day works from the next print on. Prices on the ex-date and after are as given, and repeated rows stay.
    Rows without ticker or date are left out. A dividend that is not below the last close is not booked: see ``unbooked_dividends``.
    """
    share = F.lit(1.0) / F.col("split")
    lowered = share * _paid(F.col("dividend"), F.col("last_close")) if dividends else share
    marked = _course(prices, actions).withColumns(
        {"lowered": F.when(~F.col("printed"), lowered).otherwise(1.0), "issued": F.when(~F.col("printed"), F.col("split")).otherwise(1.0)}
    )
    # Backwards in time, a print of the ex-date comes before the action.
    after = Window.partitionBy("ticker").orderBy(F.desc("date"), F.desc("printed")).rowsBetween(Window.unboundedPreceding, 0)
    factored = marked.withColumns({"factor": F.product("lowered").over(after), "shares": F.product("issued").over(after)}).filter("printed")
    return _quoted(prices).join(factored.select("ticker", "date", "factor", "shares"), ["ticker", "date"]).select(
        "ticker", "date", (F.col("open") * F.col("factor")).alias("open"), (F.col("close") * F.col("factor")).alias("close"),
        (F.col("volume") * F.col("shares")).alias("volume"), "factor",
    )


def unbooked_dividends(prices: DataFrame, actions: DataFrame) -> DataFrame:
    """(ticker, date, dividend, last_close): dividends that took all of the last close or more, to be looked at."""
    wrong = _course(prices, actions).filter(~F.col("printed") & (F.col("dividend") >= F.col("last_close")))
    return wrong.select("ticker", "date", "dividend", "last_close")
