"""Basket and exit reports: aggregates over the panel and over price paths."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.returns import simple_return
from tidemark.operators import sessions
from tidemark.session import materialize

# Assumed defaults: round-trip spread by average daily turnover, least liquid first; commission
# a side; impact per unit of daily turnover taken; sessions the turnover is averaged over.
SPREADS = ((50_000.0, 0.020), (200_000.0, 0.010), (1_000_000.0, 0.004))
TIGHTEST_SPREAD = 0.001
COMMISSION = 0.0005
IMPACT = 0.1
ADV_SESSIONS = 20


def monthly_cohorts(panel: DataFrame, horizon: str, value: str | None = None) -> DataFrame:
    """Equal-weight return of each month's entries, held for one horizon."""
    value = value or f"ret_{horizon}"
    return (
        panel.filter(F.col(value).isNotNull())
        .groupBy(F.trunc("entry_date", "MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("cohort_return"))
    )


def turnover_feature(sessions: int = ADV_SESSIONS) -> dict[str, Column]:
    """Price feature ``adv``: mean daily turnover over the sessions before this one."""
    before = Window.partitionBy("ticker").orderBy("t").rangeBetween(-sessions, -1)
    return {"adv": F.avg(F.col("close") * F.col("volume")).over(before)}


def spread(adv: Column) -> Column:
    cost = F.when(adv.isNull(), SPREADS[0][1])
    for bound, width in SPREADS:
        cost = cost.when(adv < bound, width)
    return cost.otherwise(TIGHTEST_SPREAD)


def trading_cost(adv: Column, position: float | Column, width: Column | None = None) -> Column:
    """Spread by liquidity, commission both ways, impact by the share of daily turnover.

    A name without known turnover pays the widest spread and full impact. ``width`` is a spread found elsewhere, as by ``with_spreads``.
    """
    size = position if isinstance(position, Column) else F.lit(float(position))
    participation = F.coalesce(F.try_divide(size, adv), F.lit(1.0))
    return (spread(adv) if width is None else width) + F.lit(2 * COMMISSION) + F.lit(IMPACT) * participation


LAST_YEAR = 2200
TOP_BIN = 64


def _bin(adv: Column) -> Column:
    """Powers of two, -1 below one and for unknown turnovers: turnovers in order have bins in order."""
    return F.when(adv >= 1, F.least(F.floor(F.log2(adv)), F.lit(TOP_BIN))).otherwise(F.lit(-1)).cast("long")


def with_spreads(trades: DataFrame, costs: DataFrame, day: str = "entry_date", adv: str = "adv") -> DataFrame:
    """Trades with the ``spread`` of a cost table (effective_date, min_adv, spread): that of the latest version in force on the day, and in it of the
    bucket with the largest ``min_adv`` that the turnover reaches.

    A version's first bucket takes all lower turnovers and unknown ones; before the first version there is no spread. Both ranges become keys: a bucket is listed
    under every year it is in force and every power of two of turnover it meets, so trades find it by an equi-join and one comparison, and never more than once.
    """
    one = costs.groupBy(F.col("effective_date").cast("date").alias("since"), F.col("min_adv").cast("double").alias("low")).agg(F.min(F.col("spread").cast("double")).alias("spread"))
    dates = one.select("since").distinct().withColumn("until", F.lead("since").over(Window.orderBy("since")))  # one row per version
    by_low = Window.partitionBy("since").orderBy("low")
    ranges = one.join(dates, "since").select(
        "since", "until", "spread", F.when(F.row_number().over(by_low) > 1, F.col("low")).alias("low"), F.lead("low").over(by_low).alias("high")
    )
    years = F.sequence(F.year("since"), F.coalesce(F.year("until"), F.lit(LAST_YEAR)))
    bins = F.sequence(_bin(F.col("low")), F.when(F.col("high").isNull(), F.lit(TOP_BIN).cast("long")).otherwise(_bin(F.col("high"))))
    index = ranges.withColumn("cost_year", F.explode(years)).withColumn("cost_bin", F.explode(bins))
    keyed = trades.withColumns({"cost_year": F.year(day), "cost_bin": _bin(F.col(adv))})
    left, right = keyed.alias("trade"), index.alias("cost")
    met = (
        (F.col("trade.cost_year") == F.col("cost.cost_year")) & (F.col("trade.cost_bin") == F.col("cost.cost_bin"))
        & (F.col(f"trade.{day}") >= F.col("cost.since")) & (F.col("cost.until").isNull() | (F.col(f"trade.{day}") < F.col("cost.until")))
        & (F.col("cost.low").isNull() | (F.col(f"trade.{adv}") >= F.col("cost.low")))
        & (F.col("cost.high").isNull() | F.coalesce(F.col(f"trade.{adv}") < F.col("cost.high"), F.col("cost.low").isNull()))
    )
    return left.join(right, met, "left").select(*[F.col(f"trade.{c}").alias(c) for c in trades.columns], F.col("cost.spread").alias("spread"))


def net_returns(panel: DataFrame, horizon: str, position: float = 10_000.0) -> DataFrame:
    """Panel rows (which carry ``adv``, and maybe ``spread``) with their cost and the horizon's net return."""
    cost = trading_cost(F.col("adv"), position, F.col("spread") if "spread" in panel.columns else None)
    return panel.withColumn("cost", cost).withColumn(
        f"net_{horizon}", F.col(f"ret_{horizon}") - F.col("cost")
    )


def walk_forward(panel: DataFrame, value: str, embargo_days: int = 0) -> DataFrame:
    """(fold, side, n, mean): each year tested against all entries settled before it.

    Rows fold to one per entry date first; only those few dates are spread over the years they
    train. ``embargo_days`` keeps trades that were still open at the year's start out of training.
    """
    daily = (
        panel.filter(F.col(value).isNotNull())
        .groupBy("entry_date")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    )
    final = F.max(F.year("entry_date")).over(Window.partitionBy())
    year = F.year("entry_date")
    settled = F.date_add("entry_date", embargo_days) < F.make_date("fold", F.lit(1), F.lit(1))
    return (
        daily.withColumn("last_year", final)
        .select("entry_date", "n", "total", F.explode(F.sequence(year, F.col("last_year"))).alias("fold"))
        .withColumn("side", F.when(F.col("fold") == year, "test").when(settled, "train"))
        .filter(F.col("side").isNotNull())
        .groupBy(F.col("fold").cast("long").alias("fold"), "side")
        .agg(
            F.sum("n").alias("n"),
            (F.sum("total") / F.sum("n")).alias("mean"),
        )
    )


def fold_means(panel: DataFrame, value: str, folds: DataFrame) -> DataFrame:
    """(fold, side, n, mean) for any table of folds (fold, side, start, end): entries from start on and before end.

    Folds may overlap, roll or leave gaps between their sides, and there may be any number of them: no row is copied into a fold. Rows fold to one per
    entry date, their counts and sums run on over the dates, and every side is the difference between two places of that
    course, each found by its day. The course has one row per calendar day, whatever the panel's size. A side without
    entries has n = 0 and no mean.
    """
    daily = (
        panel.filter(F.col(value).isNotNull() & F.col("entry_date").isNotNull())
        .groupBy(F.col("entry_date").alias("date"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    )
    in_order = Window.orderBy("date")
    running = daily.select(
        "date", F.sum("n").over(in_order).alias("n"), F.sum("total").over(in_order).alias("total"),
        F.coalesce(F.date_sub(F.lead("date").over(in_order), 1), F.col("date")).alias("until"),
    )
    course = materialize(running.select(F.explode(F.sequence("date", "until")).alias("day"), "n", "total"))
    last = course.agg(F.max("day")).scalar()
    ends = F.array(*[F.struct(F.lit(sign).alias("sign"), F.least(F.date_sub(end, 1), last).alias("day")) for sign, end in ((1, "end"), (-1, "start"))])
    # Days before the first entry are not on the course, and stand for nothing so far.
    met = folds.select("fold", "side", F.inline(ends)).join(course, "day", "left")
    parts = met.groupBy("fold", "side").agg(
        F.coalesce(F.sum(F.col("sign") * F.col("n")), F.lit(0)).alias("n"), F.sum(F.col("sign") * F.col("total")).alias("total")
    )
    return parts.select("fold", "side", "n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean"))


def walk_forward_choice(panel: DataFrame, horizons: dict[str, int], prefix: str = "abn", embargo_days: int = 0) -> DataFrame:
    """(fold, horizon, n_train, train_mean, n_test, test_mean): the horizon a year's training favours, tested in that year.

    Horizons compare by their mean per session held, as known before the fold; ties go to the shorter one. Years
    without training, or without a test of the chosen horizon, are left out.
    """
    held = F.create_map(*[F.lit(x) for h, n in horizons.items() for x in (h, n)])
    grids = [walk_forward(panel, f"{prefix}_{h}", embargo_days).withColumn("horizon", F.lit(h)) for h in horizons]
    grid = reduce(lambda a, b: a.unionByName(b), grids).withColumn("steps", held[F.col("horizon")])
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    wide = grid.groupBy("fold", "horizon", "steps").agg(
        side("train", "n").alias("n_train"), side("train", "mean").alias("train_mean"),
        side("test", "n").alias("n_test"), side("test", "mean").alias("test_mean"),
    )
    trained = wide.filter(F.col("n_train").isNotNull())
    chosen = trained.groupBy("fold").agg(
        F.max_by(
            F.struct("horizon", "n_train", "train_mean", "n_test", "test_mean"),
            F.struct(F.col("train_mean") / F.col("steps"), -F.col("steps")),
        ).alias("best")
    )
    return chosen.select("fold", "best.*").filter(F.col("n_test").isNotNull())


def time_split(panel: DataFrame, value: str, cutoff, embargo_days: int = 0) -> DataFrame:
    """In-sample before the cutoff, out-of-sample from it on."""
    day = F.col("entry_date")
    side = F.when(day >= F.lit(cutoff), "test").when(
        F.date_add(day, embargo_days) < F.lit(cutoff), "train"
    )
    return (
        panel.filter(F.col(value).isNotNull())
        .withColumn("side", side)
        .filter(F.col("side").isNotNull())
        .groupBy("side")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    )


def performance(trades: DataFrame, value: str, participation: float = 0.01) -> DataFrame:
    """One row: CAGR, Sharpe, drawdown, hit rate, turnover and capacity of monthly cohorts.

    Trades fold to months before anything is ordered. Turnover is new positions per month;
    capacity is what a given share of the entered names' daily turnover could have taken.
    """
    months = (
        trades.filter(F.col(value).isNotNull())
        .groupBy(F.trunc("entry_date", "MM").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("r"),
            F.count_if(F.col(value) > 0).alias("wins"),
            F.sum(F.coalesce(F.col("adv"), F.lit(0.0)) * participation).alias("room"),
        )
    )
    return with_equity(months).agg(
        *series_stats(),
        F.sum("n").alias("trades"),
        (F.sum("wins") / F.sum("n")).alias("hit_rate"),
        F.avg("n").alias("turnover"),
        F.avg("room").alias("capacity"),
    )


def with_equity(months: DataFrame, *by: str) -> DataFrame:
    """Months with return ``r``, in order: adds what one unit has come to, and the highest it has been."""
    in_order = Window.partitionBy(*by).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return months.withColumn("equity", F.product(1 + F.col("r")).over(in_order)).withColumn(
        "peak", F.greatest(F.lit(1.0), F.max("equity").over(in_order))
    )


def series_stats() -> list[Column]:
    """Aggregates over ``with_equity``: months, CAGR, Sharpe, largest drawdown."""
    return [
        F.count(F.lit(1)).alias("months"),
        (F.pow(F.product(1 + F.col("r")), F.lit(12.0) / F.count(F.lit(1))) - 1).alias("cagr"),
        (F.try_divide(F.avg("r"), F.stddev("r")) * F.sqrt(F.lit(12.0))).alias("sharpe"),
        F.min(F.col("equity") / F.col("peak") - 1).alias("max_drawdown"),
    ]


def capacity_curve(trades: DataFrame, value: str, positions: Sequence[float], participation: float = 0.01) -> DataFrame:
    """One row per position size: what monthly cohorts earn net of costs when every trade has that size.

    Impact is linear in the position, so a month folds to its mean return before impact and its mean impact per unit of position, and all
    sizes are worked out on months. ``fillable`` is the share of trades whose position is at most ``participation`` of the name's daily turnover; ``break_even`` is the size at which
    the mean trade earns nothing (0 if it loses at any size, null if no size matters). Names without known turnover pay full impact at any size, and are never
    fillable. A month loses no more than everything.
    """
    adv = F.col("adv")
    known = adv > 0
    width = F.col("spread") if "spread" in trades.columns else spread(adv)
    before = F.col(value) - width - F.lit(2 * COMMISSION) - F.when(known, 0.0).otherwise(IMPACT)
    fits = [F.count_if(adv * participation >= float(p)).alias(f"fits_{i}") for i, p in enumerate(positions)]
    months = (
        trades.filter(F.col(value).isNotNull())
        .groupBy(F.trunc("entry_date", "MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(before).alias("base"), F.avg(F.when(known, IMPACT / adv).otherwise(0.0)).alias("slope"), *fits)
    )
    sizes = F.array(*[F.struct(F.lit(float(p)).alias("position"), F.col(f"fits_{i}").alias("fits")) for i, p in enumerate(positions)])
    sized = months.select("month", "n", "base", "slope", F.inline(sizes)).withColumn("net", F.col("base") - F.col("slope") * F.col("position"))
    path = with_equity(sized.withColumn("r", F.greatest(F.col("net"), F.lit(-1.0))), "position")
    mean = lambda c: F.try_divide(F.sum(F.col("n") * F.col(c)), F.sum("n"))
    worth = F.try_divide(F.sum(F.col("n") * F.col("base")), F.sum(F.col("n") * F.col("slope")))
    return path.groupBy("position").agg(
        *series_stats(),
        F.sum("n").alias("trades"),
        F.try_divide(F.sum("fits"), F.sum("n")).alias("fillable"),
        mean("net").alias("mean_net"),
        F.when(worth.isNotNull(), F.greatest(worth, F.lit(0.0))).alias("break_even"),
    )


def terminal_prints(px: DataFrame, delistings: DataFrame, calendar: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Session prices with each delisting as a last print, at its recovery: adds ``life`` and ``terminal``, keeps ``carry`` (null in last prints).

    The print stands at the first session on or after the delisting; past the calendar's end there is none. A ticker's prints from that
    day on belong to its next life, as in the panel, where an entry on the day itself meets the delisting after.
    """
    daily = delistings.groupBy("ticker", F.col("delist_date").cast("date").alias("filing_date")).agg(
        F.min(F.coalesce("recovery_value", F.lit(0.0))).alias("close")
    )
    ends = sessions.first_tradable_session(daily.filter(F.col("filing_date").isNotNull()), calendar).filter(F.col("entry_t").isNotNull())
    ends = ends.select("ticker", F.col("entry_t").cast("long").alias("t"), F.col("filing_date").alias("day"), "close", F.lit(1).alias("ends"))
    prints = px.select("ticker", "t", F.col("cal_date").alias("day"), "close", F.lit(0).alias("ends"), *carry)
    so_far = Window.partitionBy("ticker").orderBy("day", F.desc("ends")).rowsBetween(Window.unboundedPreceding, 0)
    return prints.unionByName(ends, allowMissingColumns=True).select(
        "ticker", "t", "close", (F.sum("ends").over(so_far) - F.col("ends")).alias("life"), (F.col("ends") == 1).alias("terminal"), *carry
    )


def forward_paths(px: DataFrame, hold: int, entries: DataFrame | None = None) -> DataFrame:
    """(ticker, entry_t, entry_close, path, hold_close): each entry's next ``hold`` sessions.

    ``path`` lists the later prints in order, each with the print that follows it. It is built
    inside the ticker's partition and holds at most ``hold`` prints. With ``entries``, distinct
    (ticker, entry_t) rows, only those sessions keep their path; they are marked before the
    ticker's rows are brought together. Prices with ``life`` and ``terminal`` (``terminal_prints``) have paths that end with a life: its last print fills
    its own orders, and is what a hold over it comes to.
    """
    lives = "life" in px.columns
    px = px.filter(F.col("close").isNotNull())
    if not lives:
        px = px.withColumns({"life": F.lit(0), "terminal": F.lit(False)})
    if entries is None:
        px = px.withColumn("wanted", ~F.col("terminal"))
    else:
        marks = entries.select("ticker", F.col("entry_t").alias("t"), F.lit(True).alias("wanted"))
        px = px.join(marks, ["ticker", "t"], "left").withColumn("wanted", F.col("wanted") & ~F.col("terminal"))
    by_t = Window.partitionBy("ticker", "life").orderBy("t")
    gone = F.max(F.when(F.col("terminal"), F.col("close"))).over(by_t.rangeBetween(1, hold))
    held = F.max(F.when(~F.col("terminal"), F.col("close"))).over(by_t.rangeBetween(hold, hold))
    return (
        px.repartition("ticker")
        .withColumn("fill", F.when(F.col("terminal"), F.col("close")).otherwise(F.lead("close").over(by_t)))
        .select(
            "ticker",
            F.col("t").alias("entry_t"),
            F.col("close").alias("entry_close"),
            "wanted",
            F.collect_list(F.struct("close", "fill")).over(by_t.rangeBetween(1, hold)).alias("path"),
            (F.coalesce(gone, held) if lives else held).alias("hold_close"),
        )
        .filter("wanted")
        .drop("wanted")
    )


def _follow(path: Column, entry: Column, activate: float, trail: float, wide_trail: float) -> Column:
    """One walk along the path: where the stop, the double and the stop after it were filled.

    An order goes in at a close and fills at the next print, wherever that is. The stop arms at
    +``activate`` and triggers a trail's width below the peak; the wide one arms on the double.
    """
    none = F.lit(None).cast("double")
    start = F.struct(
        entry.alias("peak"),
        F.lit(False).alias("stopped"),
        none.alias("stop_fill"),
        F.lit(False).alias("doubled"),
        none.alias("double_fill"),
        F.lit(False).alias("released"),
        none.alias("rest_fill"),
    )

    def step(state: Column, print_: Column) -> Column:
        close, fill = print_["close"], print_["fill"]
        peak = F.greatest(state["peak"], close)
        stop = ~state["stopped"] & (peak >= entry * (1 + activate)) & (close <= peak * (1 - trail))
        double = ~state["doubled"] & (close >= entry * 2)
        rest = ~state["released"] & (peak >= entry * 2) & (close <= peak * (1 - wide_trail))
        return F.struct(
            peak.alias("peak"),
            (state["stopped"] | stop).alias("stopped"),
            F.when(stop, fill).otherwise(state["stop_fill"]).alias("stop_fill"),
            (state["doubled"] | double).alias("doubled"),
            F.when(double, fill).otherwise(state["double_fill"]).alias("double_fill"),
            (state["released"] | rest).alias("released"),
            F.when(rest, fill).otherwise(state["rest_fill"]).alias("rest_fill"),
        )

    return F.aggregate(path, start, step)


def exit_overlays(
    px: DataFrame,
    hold: int,
    activate: float = 0.10,
    trail: float = 0.10,
    wide_trail: float = 0.30,
    entries: DataFrame | None = None,
) -> DataFrame:
    """(ticker, entry_t, fixed, trailing_stop, scale_out): each exit rule's return per entry.

    Fixed hold is the baseline. The trailing stop arms at +``activate``. Scale-out sells half on
    a double and leaves the rest under a wide trail that the double arms.
    """
    walked = forward_paths(px, hold, entries).withColumn(
        "end", _follow(F.col("path"), F.col("entry_close"), activate, trail, wide_trail)
    )
    fixed, trailing_stop, scale_out = _exit_returns("end")
    return walked.select(
        "ticker",
        "entry_t",
        fixed.alias("fixed"),
        trailing_stop.alias("trailing_stop"),
        scale_out.alias("scale_out"),
        F.col("end.stopped").alias("stopped"),
        F.col("end.doubled").alias("doubled"),
    )


def _exit_returns(end: str) -> tuple[Column, Column, Column]:
    """Fixed hold, trailing stop and scale-out of a walked path."""
    entry = F.col("entry_close")
    fixed = simple_return(entry, F.col("hold_close"))

    def filled(hit: str, fill: str) -> Column:
        return F.when(F.col(f"{end}.{hit}"), simple_return(entry, F.col(f"{end}.{fill}"))).otherwise(fixed)

    half = simple_return(entry, F.col(f"{end}.double_fill"))
    scaled = F.when(F.col(f"{end}.doubled"), (half + filled("released", "rest_fill")) / 2)
    return fixed, filled("stopped", "stop_fill"), scaled.otherwise(fixed)


def exit_walk_forward(
    entries: DataFrame, px: DataFrame, hold: int, settings: Sequence[tuple[float, float, float]], embargo_days: int
) -> DataFrame:
    """(fold, rule, setting, n_train, train_gain, n_test, test_gain): exit rules out of sample, against the fixed hold.

    ``entries`` are (ticker, entry_t, entry_date, weight); a setting is (activate, trail, wide_trail) and goes by its place. Each year, either
    rule takes the setting that gained most over the fixed hold on entries settled before it (``embargo_days`` after entry, which
    should cover the hold; ties go to the earlier setting), and is tested on the year's entries. Gains are over entries where both
    exits are known. Years without training, or without a test, are left out. Paths are built once for all settings, and entries fold to days before they are spread over years.
    """
    walked = forward_paths(px, hold, entries)
    ends = {f"end_{i}": _follow(F.col("path"), F.col("entry_close"), *s) for i, s in enumerate(settings)}
    cells = []
    for i, end in enumerate(ends):
        fixed, stop, scaled = _exit_returns(end)
        for rule, exit_ in (("trailing_stop", stop), ("scale_out", scaled)):
            cells.append(F.struct(F.lit(rule).alias("rule"), F.lit(i).cast("long").alias("setting"), (exit_ - fixed).alias("gain")))
    gains = walked.withColumns(ends).select("ticker", "entry_t", F.inline(F.array(*cells))).filter(F.col("gain").isNotNull())
    daily = materialize(
        gains.join(entries, ["ticker", "entry_t"])
        .groupBy("rule", "setting", "entry_date")
        .agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("gain")).alias("total"))
    )
    year = F.year("entry_date")
    final = daily.agg(F.max(year)).scalar()
    settled = F.date_add("entry_date", embargo_days) < F.make_date("fold", F.lit(1), F.lit(1))
    sided = daily.withColumn("fold", F.explode(F.sequence(year, final))).withColumn("side", F.when(F.col("fold") == year, "test").when(settled, "train"))
    of = lambda side, c: F.sum(F.when(F.col("side") == side, F.col(c)))
    wide = sided.groupBy(F.col("fold").cast("long").alias("fold"), "rule", "setting").agg(
        of("train", "n").alias("n_train"), F.try_divide(of("train", "total"), of("train", "n")).alias("train_gain"),
        of("test", "n").alias("n_test"), F.try_divide(of("test", "total"), of("test", "n")).alias("test_gain"),
    )
    chosen = wide.filter(F.col("n_train") > 0).groupBy("fold", "rule").agg(
        F.max_by(F.struct("setting", "n_train", "train_gain", "n_test", "test_gain"), F.struct("train_gain", -F.col("setting"))).alias("best")
    )
    return chosen.select("fold", "rule", "best.*").filter(F.col("n_test") > 0)


def entry_counts(placed: DataFrame, *carry: str) -> DataFrame:
    """(ticker, entry_t, weight): a crowded session becomes one row. ``carry`` names columns that the session fixes, as its date."""
    return (
        placed.filter(F.col("ticker").isNotNull() & F.col("entry_t").isNotNull())
        .groupBy("ticker", F.col("entry_t").cast("long").alias("entry_t"), *carry)
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def exit_report(entries: DataFrame, overlays: DataFrame) -> DataFrame:
    """One row per exit rule over counted, priced entries.

    ``n``, ``mean`` and ``hit_rate`` are over entries whose exit is known, ``left_out`` counts the others.
    ``mean_vs_fixed`` compares the rule with the fixed hold on the ``n_paired`` entries where both are known.
    """
    joined = entries.join(overlays, ["ticker", "entry_t"])
    rules = ("fixed", "trailing_stop", "scale_out")
    weight = F.col("weight")
    sums = []
    for r in rules:
        sums.append(F.coalesce(F.sum(F.when(F.col(r).isNotNull(), weight)), F.lit(0)).alias(f"n_{r}"))
        sums.append(F.sum(weight * F.col(r)).alias(f"total_{r}"))
        sums.append(F.sum(F.when(F.col(r) > 0, weight).otherwise(0)).alias(f"hits_{r}"))
        sums.append(F.coalesce(F.sum(F.when(F.col(r).isNull(), weight)), F.lit(0)).alias(f"out_{r}"))
        paired = F.col(r) - F.col("fixed")
        sums.append(F.coalesce(F.sum(F.when(paired.isNotNull(), weight)), F.lit(0)).alias(f"pairs_{r}"))
        sums.append(F.sum(weight * paired).alias(f"gain_{r}"))
    cells = [
        F.struct(
            F.lit(r).alias("rule"),
            F.col(f"n_{r}").alias("n"),
            F.try_divide(F.col(f"total_{r}"), F.col(f"n_{r}")).alias("mean"),
            F.try_divide(F.col(f"hits_{r}"), F.col(f"n_{r}")).alias("hit_rate"),
            F.col(f"out_{r}").alias("left_out"),
            F.col(f"pairs_{r}").alias("n_paired"),
            F.try_divide(F.col(f"gain_{r}"), F.col(f"pairs_{r}")).alias("mean_vs_fixed"),
        )
        for r in rules
    ]
    return joined.agg(*sums).select(F.inline(F.array(*cells)))


def partial_pooling(rows: DataFrame, value: str, segment: str = "role_bucket") -> DataFrame:
    """Insider estimates pulled towards their segment by how little evidence there is.

    estimate = segment mean + n / (n + k) x (own mean - segment mean), where k is the within-
    insider variance over the between-insider variance. The second aggregate runs over the
    insiders of the first, so rows are read once.
    """
    own = (
        rows.filter(F.col(value).isNotNull())
        .groupBy(segment, "insider_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("own_mean"),
            F.coalesce(F.var_samp(value), F.lit(0.0)).alias("own_var"),
        )
    )
    free = F.sum(F.col("n") - 1)
    groups = own.groupBy(segment).agg(
        (F.sum(F.col("n") * F.col("own_mean")) / F.sum("n")).alias("segment_mean"),
        F.try_divide(F.sum((F.col("n") - 1) * F.col("own_var")), free).alias("within"),
        F.var_samp("own_mean").alias("spread"),
        F.avg(1 / F.col("n")).alias("mean_inverse_n"),
    )
    between = F.greatest(F.col("spread") - F.col("within") * F.col("mean_inverse_n"), F.lit(0.0))
    pooled = groups.select(
        segment, "segment_mean", F.try_divide(F.col("within"), between).alias("k")
    )
    # Without a measurable difference between insiders, everyone gets the segment mean.
    weight = F.coalesce(F.col("n") / (F.col("n") + F.col("k")), F.lit(0.0))
    return own.join(pooled, segment).select(
        segment,
        "insider_id",
        "n",
        "own_mean",
        "segment_mean",
        (F.col("segment_mean") + weight * (F.col("own_mean") - F.col("segment_mean"))).alias("estimate"),
    )


def pooling_out_of_sample(
    rows: DataFrame, value: str, cutoff, embargo_days: int = 0, segment: str = "role_bucket"
) -> DataFrame:
    """One row per predictor of trades from the cutoff on: does an insider's past beat the segment's mean?

    Estimates come from trades settled before the cutoff; the test is on later trades of insiders seen by then.
    Trades fold to one row per insider before they meet the estimates, so a busy insider is no one task's work.
    """
    day = F.col("entry_date")
    known = partial_pooling(rows.filter(F.date_add(day, embargo_days) < F.lit(cutoff)), value, segment)
    later = (
        rows.filter((day >= F.lit(cutoff)) & F.col(value).isNotNull())
        .groupBy(segment, "insider_id")
        .agg(F.count(F.lit(1)).alias("trades"), F.sum(value).alias("total"), F.sum(F.col(value) * F.col(value)).alias("squares"))
    )
    met = later.join(known.drop("n"), [segment, "insider_id"])
    error = lambda c: F.sum(F.col("squares") - 2 * F.col(c) * F.col("total") + F.col("trades") * F.col(c) * F.col(c))
    names = {"segment_mean": "segment", "estimate": "pooled", "own_mean": "own"}
    sums = met.agg(F.coalesce(F.sum("trades"), F.lit(0)).alias("n"), *[error(c).alias(c) for c in names])
    cells = [F.struct(F.lit(label).alias("predictor"), "n", F.try_divide(F.col(c), F.col("n")).alias("mse")) for c, label in names.items()]
    return sums.select(F.inline(F.array(*cells)))
