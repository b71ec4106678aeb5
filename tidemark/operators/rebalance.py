"""The basket as one portfolio through time: rebalanced monthly, filled at the next print, charged for what it trades.

Cohort reports average trades that overlap. Here a name is held once, however many signals stand behind it, and a month's return
is that of what was held in it. Signals fold to (ticker, month) and prices to one fill a month before they meet, so all
windows run over tickers x months, in one partitioning by ticker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.returns import simple_return
from tidemark.operators import basket, ladder, sessions
from tidemark.session import materialize


def rebalance_periods(numbered: DataFrame) -> DataFrame:
    """(t, cal_date, opens, period): the first session of each month is a rebalance, and period m is the time after rebalance m up to the next, inclusive.

    Sessions up to the first rebalance are in period -1.
    """
    by_t = Window.orderBy("t")
    month = F.trunc("cal_date", "MM")
    opened = F.sum(F.col("opens").cast("int")).over(by_t.rowsBetween(Window.unboundedPreceding, -1))
    return numbered.withColumn("opens", F.coalesce(month != F.lag(month).over(by_t), F.lit(True))).select(
        F.col("t").cast("long").alias("t"), "cal_date", "opens", (F.coalesce(opened, F.lit(0)) - 1).alias("period")
    )


def positions(
    signals: DataFrame,
    prices: DataFrame,
    calendar: DataFrame,
    hold_months: int,
    delistings: DataFrame | None = None,
    entry_field: str = "open",
) -> DataFrame:
    """(ticker, life, m, held, was_held, fill, month_return, last_return): names held after rebalance m, or before it.

    ``signals`` are (ticker, entry_t, entry_date). A signal is known at its entry session and asks for its name from the first rebalance on or
    after it, for ``hold_months`` rebalances; further signals extend that. Orders given at a rebalance are filled at ``entry_field`` of the name's first print after it. If there is none before the next rebalance, the name stays as
    it was, held or not, at its last fill's price. Returns run from fill to fill. A delisting ends a life: its holders get what is recovered, and a
    reused ticker starts anew. Names never traded again, and without a delisting, are held at a stale price (``fill`` is null).
    """
    numbered = sessions.numbered_sessions(calendar)
    periods = materialize(rebalance_periods(numbered))
    last = periods.agg(F.sum(F.col("opens").cast("int")) - 1).scalar()
    at_session = F.broadcast(periods.select("t", F.col("period").alias("m")))

    calls = (
        signals.filter(F.col("ticker").isNotNull() & F.col("entry_t").isNotNull())
        .select("ticker", F.col("entry_t").cast("long").alias("t"), "entry_date")
        .distinct()
    )
    calls = calls.join(at_session, "t").withColumn("m", F.col("m") + 1).filter(F.col("m") <= last)
    px = ladder.session_prices(prices, numbered).withColumns(basket.turnover_feature())
    if delistings is None:
        calls = calls.withColumn("life", F.lit(0).cast("long"))
        px = px.withColumns({"life": F.lit(0).cast("long"), "terminal": F.lit(False)})
    else:
        before = F.size(F.filter("history", lambda d: d["delist_date"] <= F.col("entry_date")))
        calls = calls.join(ladder.delisting_history(delistings), "ticker", "left").withColumn("life", F.when(F.col("history").isNull(), 0).otherwise(before).cast("long"))
        px = basket.terminal_prints(px, delistings, calendar, carry=sorted({entry_field, "adv"} - {"close"}))
    calls = calls.select("ticker", "life", "m").distinct().withColumn("called", F.lit(True))

    traded = F.when(~F.col("terminal") & F.col(entry_field).isNotNull(), F.struct("t", F.col(entry_field).alias("price"), "adv"))
    fills = (
        px.join(at_session, "t")
        .groupBy("ticker", "life", "m")
        .agg(F.min(traded).alias("fill"), F.max(F.when(F.col("terminal"), F.col("close"))).alias("recovered"))
    )
    lives = calls.groupBy("ticker", "life").agg(F.min("m").alias("first"))
    grid = lives.select("ticker", "life", F.explode(F.sequence("first", last)).alias("m"))
    laid = grid.join(fills, ["ticker", "life", "m"], "left").join(calls, ["ticker", "life", "m"], "left")

    by_m = Window.partitionBy("ticker", "life").orderBy("m")
    so_far = by_m.rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.coalesce(F.max("called").over(by_m.rangeBetween(1 - hold_months, 0)), F.lit(False))
    mark = F.last("fill.price", ignorenulls=True).over(so_far)
    course = (
        laid.withColumn("over", F.coalesce(F.max(F.col("recovered").isNotNull()).over(by_m.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
        .filter(~F.col("over"))
        .withColumns({"wanted": wanted, "mark": mark})
        .withColumn("held", F.coalesce(F.last(F.when(F.col("fill").isNotNull(), F.col("wanted")), ignorenulls=True).over(so_far), F.lit(False)))
        .withColumn("month_return", simple_return(F.col("mark"), F.coalesce("recovered", F.lead("mark").over(by_m))))
        .withColumns({"was_held": F.coalesce(F.lag("held").over(by_m), F.lit(False)), "last_return": F.lag("month_return").over(by_m)})
    )
    return course.filter((F.col("held") | F.col("was_held")) & (F.col("m") < last)).select(
        "ticker", "life", "m", "held", "was_held", "fill", "month_return", "last_return"
    )


def monthly_series(
    signals: DataFrame,
    prices: DataFrame,
    calendar: DataFrame,
    hold_months: int = 3,
    capital: float = 1_000_000.0,
    delistings: DataFrame | None = None,
    entry_field: str = "open",
) -> DataFrame:
    """(month, n, entered, departed, stale, traded, gross, cost, r), one row per rebalance from the first signal's to the last but one.

    Every name held has the same weight after a rebalance. ``traded`` is the sum of the differences from where the last month's returns had taken the weights, over names that
    were filled; ``cost`` is half a round trip on each, with impact for an order of that share of ``capital``; ``r`` is net. ``stale`` names could
    not be traded; they count with the weight of the others. A month without names earns nothing. A delisted name is paid out without a trade.
    """
    held = materialize(positions(signals, prices, calendar, hold_months, delistings, entry_field))
    months = held.groupBy("m").agg(
        F.count_if("held").alias("n"),
        F.count_if(F.col("held") & ~F.col("was_held")).alias("entered"),
        F.count_if(~F.col("held")).alias("departed"),
        F.count_if(F.col("held") & F.col("fill").isNull()).alias("stale"),
        F.coalesce(F.avg(F.when(F.col("held"), F.col("month_return"))), F.lit(0.0)).alias("gross"),
    )
    # One row a month, whatever the data's size.
    now = F.broadcast(months.select("m", F.col("n").alias("n_now")))
    before = F.broadcast(months.select((F.col("m") + 1).alias("m"), F.col("n").alias("n_before"), F.col("gross").alias("gross_before")))
    share = lambda flag, n: F.when(F.col(flag), F.try_divide(F.lit(1.0), F.col(n))).otherwise(0.0)
    drift = F.try_divide(1 + F.coalesce("last_return", F.lit(0.0)), 1 + F.col("gross_before"))
    moved = F.abs(share("held", "n_now") - F.coalesce(share("was_held", "n_before") * drift, F.lit(0.0)))
    orders = held.join(now, "m").join(before, "m", "left").filter(F.col("fill").isNotNull()).withColumn("moved", moved)
    cost = basket.trading_cost(F.col("fill.adv"), F.col("moved") * F.lit(float(capital))) / 2
    paid = orders.groupBy("m").agg(F.sum("moved").alias("traded"), F.sum(F.col("moved") * cost).alias("cost"))

    numbered = rebalance_periods(sessions.numbered_sessions(calendar))
    rebalances = numbered.filter("opens").select((F.col("period") + 1).alias("m"), F.col("cal_date").alias("month"))
    span = months.agg(F.min("m")).scalar()
    final = rebalances.agg(F.max("m")).scalar()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "entered", "departed", "stale")]
    sums = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("traded", "gross", "cost")]
    whole = rebalances.filter((F.col("m") >= span) & (F.col("m") < final)).join(months, "m", "left").join(paid, "m", "left")
    return whole.select("month", *counts, *sums).withColumn("r", F.col("gross") - F.col("cost"))


def series_report(series: DataFrame) -> DataFrame:
    """One row over a monthly series: months, CAGR, Sharpe, largest drawdown, share of winning months, mean names and mean turnover."""
    return basket.with_equity(series).agg(
        *basket.series_stats(),
        F.try_divide(F.count_if(F.col("r") > 0), F.count(F.lit(1))).alias("hit_rate"),
        F.avg("n").alias("names"),
        F.avg("traded").alias("turnover"),
        F.avg("cost").alias("mean_cost"),
    )
