"""Trading sessions: the calendar, its numbering, and entry without look-ahead.

The calendar is the one thing broadcast unconditionally. It holds one row per calendar day
between two dates, so its size is fixed by the calendar (about 37,000 rows a century) and not
by the number of events or prices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.returns import simple_return


def trading_calendar(benchmark: DataFrame) -> DataFrame:
    """Distinct sessions of the benchmark."""
    return benchmark.select(F.col("date").cast("date").alias("date")).distinct()


def numbered_sessions(calendar: DataFrame, column: str = "date") -> DataFrame:
    """Sessions as (t, cal_date), t counting from 0 in date order."""
    days = F.sort_array(F.collect_set(F.col(column).cast("date")))
    return calendar.agg(days.alias("days")).select(
        F.posexplode("days").alias("t", "cal_date")
    )


def entry_calendar(
    sessions: DataFrame,
    benchmark: DataFrame,
    horizons: dict[str, int],
    entry_lag: int = 0,
    entry_field: str = "close",
) -> DataFrame:
    """For every calendar day: the session to enter on, exit dates and benchmark returns.

    Days between two sessions point at the later one, which turns the forward as-of join into
    an equi-join. ``lead`` is exact here because t has no gaps. The benchmark enters at the same
    field as the stock, so it must have that field.
    """
    if entry_field not in benchmark.columns:
        raise ValueError(f"the benchmark has no {entry_field} to enter at")
    market = (
        benchmark.groupBy(F.col("date").cast("date").alias("cal_date"))
        .agg(
            F.min(F.col("close").cast("double")).alias("bclose"),
            F.min(F.col(entry_field).cast("double")).alias("bentry"),
        )
    )
    by_t = Window.orderBy("t")

    def ahead(column: str, steps: int) -> Column:
        return F.lead(column, steps).over(by_t) if steps else F.col(column)

    columns = {
        "day_from": F.coalesce(F.date_add(F.lag("cal_date").over(by_t), 1), F.col("cal_date")),
        "entry_t": ahead("t", entry_lag),
        "entry_date": ahead("cal_date", entry_lag),
    }
    for label, steps in horizons.items():
        columns[f"exit_date_{label}"] = ahead("cal_date", entry_lag + steps)
        columns[f"bench_ret_{label}"] = simple_return(
            ahead("bentry", entry_lag), ahead("bclose", entry_lag + steps)
        )
    return (
        sessions.join(market, "cal_date", "left")
        .withColumns(columns)
        .select(
            F.explode(F.sequence("day_from", "cal_date")).alias("day"),
            "entry_t",
            "entry_date",
            *[f"exit_date_{label}" for label in horizons],
            *[f"bench_ret_{label}" for label in horizons],
        )
    )


def session_key(filing_date: Column, sessions: DataFrame) -> Column:
    """The day to look up: filings before the first session wait for it; null stays null."""
    first = sessions.agg(F.min("cal_date")).scalar()
    return F.when(filing_date.isNotNull(), F.greatest(filing_date.cast("date"), first))


def with_entry(events: DataFrame, sessions: DataFrame, entries: DataFrame) -> DataFrame:
    """First session on or after the filing date; none left means null, and the row stays."""
    keyed = events.withColumn("day", session_key(F.col("filing_date"), sessions))
    return keyed.join(F.broadcast(entries), "day", "left").drop("day")


def first_tradable_session(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """Events with ``entry_t`` and ``entry_date`` only."""
    sessions = numbered_sessions(calendar)
    by_t = Window.orderBy("t")
    day_from = F.coalesce(F.date_add(F.lag("cal_date").over(by_t), 1), F.col("cal_date"))
    days = sessions.withColumn("day_from", day_from).select(
        F.explode(F.sequence("day_from", "cal_date")).alias("day"),
        F.col("t").alias("entry_t"),
        F.col("cal_date").alias("entry_date"),
    )
    return with_entry(events, sessions, days)


def exit_ladder(events: DataFrame, calendar: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """Per event and horizon the exit session; past the calendar's end it is null."""
    sessions = numbered_sessions(calendar)
    flat = calendar.select("date", F.lit(1.0).alias("close"))
    placed = with_entry(events, sessions, entry_calendar(sessions, flat, horizons))
    steps = [
        F.struct(
            F.lit(h).alias("horizon"),
            (F.col("entry_t") + n).cast("long").alias("exit_t"),
            F.col(f"exit_date_{h}").alias("exit_date"),
        )
        for h, n in horizons.items()
    ]
    return placed.select(*events.columns, "entry_date", F.inline(F.array(*steps)))
