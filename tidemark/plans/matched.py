"""Returns against names of like size, or of like sector and size.

Each month the cross-section of known sizes is cut at its quantiles, and every ticker belongs to a band for that month by its
latest size as of the month's first day. The benchmark of a band is the mean return of all its tickers that could be entered on the same
session, one series per band and horizon. It is worked out over the price table, so its cost does not grow with the events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ladder, sessions
from tidemark.schemas import HORIZONS
from tidemark.session import materialize

BANDS = 3


def in_force(values: DataFrame, column: str, last_month) -> DataFrame:
    """(ticker, month, column): of (ticker, effective_date, column), what holds in each month up to ``last_month``."""
    known = values.filter(F.col(column).isNotNull() & F.col("ticker").isNotNull())
    start = F.when(F.dayofmonth("effective_date") == 1, F.col("effective_date")).otherwise(F.add_months(F.trunc("effective_date", "MM"), 1))
    # Of several values that come into force with one month the latest counts.
    dated = known.groupBy("ticker", start.cast("date").alias("month")).agg(F.max_by(column, F.struct("effective_date", column)).alias(column))
    following = F.lead("month").over(Window.partitionBy("ticker").orderBy("month"))
    until = F.coalesce(F.add_months(following, -1), F.trunc(F.lit(last_month).cast("date"), "MM"))
    spans = dated.withColumn("until", until).filter(F.col("until") >= F.col("month"))
    return spans.select("ticker", F.explode(F.sequence("month", "until", F.expr("INTERVAL 1 MONTH"))).alias("month"), column)


def monthly_bands(sizes: DataFrame, last_month, bands: int = BANDS) -> DataFrame:
    """(ticker, month, band): band 1 holds the smallest; ``sizes`` is (ticker, effective_date, size).

    A size is in force from the first month that begins on or after its date until the month the next one takes over, or until ``last_month``. The breakpoints are
    the month's quantiles; a size on a breakpoint belongs to the lower band. Rows without a size are left out.
    """
    monthly = in_force(sizes, "size", last_month)
    cuts = monthly.groupBy("month").agg(F.percentile("size", [k / bands for k in range(1, bands)]).alias("cuts"))
    band = F.size(F.filter("cuts", lambda c: c < F.col("size"))) + 1
    return monthly.join(cuts, "month").select("ticker", "month", band.alias("band"))


def size_matched_returns(
    events: DataFrame, prices: DataFrame, benchmark: DataFrame, sizes: DataFrame, bands: int = BANDS, horizons: dict[str, int] | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """accession, txn_sk, ticker, entry_date, band, ret_<h>…, abn_<h>…: returns less those of the entry session's band.

    ``benchmark`` gives the calendar. Events without an entry, a price or a known size stay, with nulls.
    """
    last = sessions.trading_calendar(benchmark).agg(F.max("date")).first()[0]
    return matched_returns(events, prices, benchmark, monthly_bands(sizes, last, bands), ("band",), horizons=horizons, carry=carry)


def sector_matched_returns(
    events: DataFrame, prices: DataFrame, benchmark: DataFrame, sectors: DataFrame, sizes: DataFrame,
    bands: int = BANDS, min_names: int = 3, horizons: dict[str, int] | None = None, carry: Sequence[str] = (),
) -> DataFrame:
    """accession, txn_sk, ticker, entry_date, sector, band, ret_<h>…, abn_<h>…: returns less those of the sector's names of like size.

    ``sectors`` is (ticker, effective_date, sector), in force by month as sizes are. Where fewer than ``min_names`` of a sector's band have the return, the whole sector
    stands in; where the sector has fewer, there is no benchmark.
    """
    last = sessions.trading_calendar(benchmark).agg(F.max("date")).first()[0]
    groups = in_force(sectors, "sector", last).join(monthly_bands(sizes, last, bands), ["ticker", "month"], "left")
    return matched_returns(events, prices, benchmark, groups, ("sector", "band"), min_names, horizons, carry)


def matched_returns(
    events: DataFrame, prices: DataFrame, benchmark: DataFrame, groups: DataFrame, keys: Sequence[str],
    min_names: int = 1, horizons: dict[str, int] | None = None, carry: Sequence[str] = (),
) -> DataFrame:
    """Returns less the mean of the group, ``groups`` being (ticker, month, keys…), one row per ticker and month.

    The group is that of all keys, or where fewer than ``min_names`` of its names have the return, that of all but the last, and so on. There is one series per group, session and horizon, worked
    out over the price table.
    """
    horizons = horizons or HORIZONS
    calendar = sessions.trading_calendar(benchmark)
    numbered = sessions.numbered_sessions(calendar)
    dated = numbered.select(F.col("t").cast("long").alias("entry_t"), F.trunc("cal_date", "MM").alias("month"))
    steps = ladder.return_ladder(prices, numbered, horizons).join(F.broadcast(dated), "entry_t")  # the calendar, bounded
    grouped = materialize(steps.join(groups, ["ticker", "month"], "left").drop("month"))
    held, levels = grouped, range(len(keys), 0, -1)
    for level in levels:
        by = keys[:level]
        means = [F.when(F.count(f"ret_{h}") >= min_names, F.avg(f"ret_{h}")).alias(f"group_{level}_{h}") for h in horizons]
        series = grouped.filter(F.col(by[-1]).isNotNull()).groupBy("entry_t", *by).agg(*means)
        held = held.join(series, ["entry_t", *by], "left")
    group = {h: F.coalesce(*[F.col(f"group_{level}_{h}") for level in levels]) for h in horizons}
    placed = sessions.first_tradable_session(events.select("accession", "txn_sk", "ticker", "filing_date", *carry), calendar)
    found = placed.withColumn("entry_t", F.col("entry_t").cast("long")).join(held, ["ticker", "entry_t"], "left")
    return found.select(
        "accession", "txn_sk", "ticker", "entry_date", *keys, *[f"ret_{h}" for h in horizons],
        *[(F.col(f"ret_{h}") - group[h]).alias(f"abn_{h}") for h in horizons], *carry,
    )
