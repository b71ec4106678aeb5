"""Segment features: what kind of purchase was it, judged by what was known on its filing date.

Windows here never run over raw events. Each feature first reduces the events to something a
calendar bounds (distinct insider-days, issuer-days, insider-months), computes on that, and
joins the result back on an equality. An issuer or insider behind a large share of all events
therefore never becomes one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.medians import with_own_size

# Titles that name the two top offices.
CEO_TITLE = r"(?i)\bceo\b|chief executive"
CFO_TITLE = r"(?i)\bcfo\b|chief financial"

# Assumed defaults: market-cap bands by upper bound; above the last one an issuer is large.
CAP_BANDS = ((300e6, "micro"), (2e9, "small"), (10e9, "mid"))


def role_bucket() -> Column:
    title = F.coalesce(F.col("title"), F.lit(""))
    return (
        F.when(title.rlike(CEO_TITLE), "CEO")
        .when(title.rlike(CFO_TITLE), "CFO")
        .when(F.col("is_director"), "Director")
        .when(F.col("is_ten_percent_owner"), "10% owner")
        .otherwise("Other")
    )


def with_role_bucket(events: DataFrame) -> DataFrame:
    return events.withColumn("role_bucket", role_bucket())


def cluster_counts(events: DataFrame, window_days: int = 30) -> DataFrame:
    """(issuer_cik, filing_date, cluster_size): distinct insiders in the trailing window.

    Each purchase makes its insider count for ``window_days`` more days, or until the insider's
    next purchase takes over. Arrivals and expiries are summed per issuer-day and accumulated,
    so the distinct count needs neither sets nor pairs.
    """
    days = (
        events.filter(F.col("filing_date").isNotNull() & F.col("insider_id").isNotNull())
        .select("issuer_cik", "insider_id", "filing_date")
        .distinct()
    )
    per_insider = Window.partitionBy("issuer_cik", "insider_id").orderBy("filing_date")
    leaves = F.least(
        F.date_add("filing_date", window_days + 1), F.lead("filing_date").over(per_insider)
    )
    steps = days.withColumn("leaves", leaves).select(
        "issuer_cik",
        F.inline(
            F.array(
                F.struct(F.col("filing_date").alias("day"), F.lit(1).alias("step")),
                F.struct(F.col("leaves").alias("day"), F.lit(-1).alias("step")),
            )
        ),
    )
    daily = steps.groupBy("issuer_cik", "day").agg(F.sum("step").alias("step"))
    running = F.sum("step").over(Window.partitionBy("issuer_cik").orderBy("day"))
    return daily.select(
        "issuer_cik", F.col("day").alias("filing_date"), running.alias("cluster_size")
    )


def with_cluster_size(events: DataFrame, window_days: int = 30) -> DataFrame:
    """Insiders without an id are not counted; an event on a day nobody counts has size 0."""
    counts = cluster_counts(events, window_days)
    joined = events.join(counts, ["issuer_cik", "filing_date"], "left")
    known = F.col("filing_date").isNotNull()
    return joined.withColumn(
        "cluster_size", F.when(known, F.coalesce("cluster_size", F.lit(0).cast("long")))
    )


def routine_months(events: DataFrame, years: int = 3) -> DataFrame:
    """(insider_id, year, month, is_routine): bought in the same month of each prior year."""
    months = (
        events.filter(F.col("filing_date").isNotNull() & F.col("insider_id").isNotNull())
        .select(
            "insider_id",
            F.year("filing_date").cast("long").alias("year"),
            F.month("filing_date").cast("long").alias("month"),
        )
        .distinct()
    )
    before = Window.partitionBy("insider_id", "month").orderBy("year").rangeBetween(-years, -1)
    return months.withColumn("is_routine", F.count(F.lit(1)).over(before) >= years)


def with_routine_flag(events: DataFrame, years: int = 3) -> DataFrame:
    keyed = events.withColumns(
        {
            "year": F.year("filing_date").cast("long"),
            "month": F.month("filing_date").cast("long"),
        }
    )
    flags = routine_months(events, years)
    return (
        keyed.join(flags, ["insider_id", "year", "month"], "left")
        .withColumn("is_routine", F.coalesce("is_routine", F.lit(False)))
        .drop("year", "month")
    )


def as_of_backward(
    left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, value: str
) -> DataFrame:
    """The latest right-hand value at or before each left row's date, per ``by``.

    Only the distinct (by, date) pairs of the left side meet the right side; both are bounded
    by the calendar per key. Repeated right-hand rows fold to the lowest value.
    """
    marks = left.filter(F.col(left_on).isNotNull()).select(
        by, F.col(left_on).alias("day"), F.lit(None).cast("double").alias("known")
    ).distinct()
    facts = right.groupBy(by, F.col(right_on).alias("day")).agg(
        F.min(F.col(value).cast("double")).alias("known")
    )
    timeline = marks.unionByName(facts).groupBy(by, "day").agg(F.max("known").alias("known"))
    so_far = Window.partitionBy(by).orderBy("day")
    filled = timeline.select(
        by,
        F.col("day").alias(left_on),
        F.last("known", ignorenulls=True).over(so_far).alias(value),
    )
    return left.join(filled, [by, left_on], "left")


def cap_band(market_cap: Column, bands=CAP_BANDS) -> Column:
    band = F.when(market_cap.isNull(), "unknown")
    for bound, label in bands:
        band = band.when(market_cap < bound, label)
    return band.otherwise("large")


def with_market_cap(events: DataFrame, caps: DataFrame, bands=CAP_BANDS) -> DataFrame:
    """Issuer size known on the filing date, its band, and the trade's value against it."""
    sized = as_of_backward(
        events, caps, "issuer_cik", "filing_date", "effective_date", "market_cap"
    )
    return sized.withColumns(
        {
            "cap_band": cap_band(F.col("market_cap"), bands),
            "value_vs_company": F.try_divide(F.col("value"), F.col("market_cap")),
        }
    )


def year_high_features() -> dict[str, Column]:
    """Price features: highest close of the last 365 days, today included, and the distance."""
    day = F.unix_date("cal_date")
    high = F.max("close").over(
        Window.partitionBy("ticker").orderBy(day).rangeBetween(-365, 0)
    )
    return {"high_52w": high, "vs_high": F.try_divide(F.col("close"), high) - F.lit(1.0)}


def add_segment_features(
    events: DataFrame, caps: DataFrame, window_days: int = 30, years: int = 3, bands=CAP_BANDS
) -> DataFrame:
    """All event features at once: role, cluster, routine, issuer size, size against the insider's own trades.

    Hand over a stored table, as each feature reads it. The features by price, such as the 52-week high, ride on the
    panel instead.
    """
    known = with_cluster_size(with_role_bucket(events), window_days)
    known = with_market_cap(with_routine_flag(known, years), caps, bands)
    return with_own_size(known)


def segment_labels() -> dict[str, Column]:
    """A label per feature, for curves by segment."""
    return {
        "role": F.col("role_bucket"),
        "cluster": F.when(F.col("cluster_size") > 1, "cluster").when(F.col("cluster_size").isNotNull(), "alone").otherwise("unknown"),
        "routine": F.when(F.col("is_routine"), "routine").otherwise("opportune"),
        "cap_band": F.col("cap_band"),
        "own_size": F.when(F.col("value_vs_own") >= 1, "larger").when(F.col("value_vs_own").isNotNull(), "smaller").otherwise("first"),
    }


def by_segment(rows: DataFrame, labels: dict[str, Column] | None = None) -> DataFrame:
    """Each row once per feature, as (feature, segment) beside it."""
    cells = [F.struct(F.lit(name).alias("feature"), label.alias("segment")) for name, label in (labels or segment_labels()).items()]
    return rows.select("*", F.inline(F.array(*cells)))
