"""Horizon curves: mean abnormal return per holding horizon, with intervals and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import bootstrap
from tidemark.schemas import EVENT_KEY, HORIZONS


def long_returns(panel: DataFrame, horizons: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The panel as one row per event and horizon."""
    labels = list(horizons or HORIZONS)
    return panel.unpivot(
        [*EVENT_KEY, *keep], [f"abn_{h}" for h in labels], "horizon", "abn"
    ).withColumn("horizon", F.replace("horizon", F.lit("abn_"), F.lit("")))


def horizon_means(
    panel: DataFrame, horizons: Sequence[str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """(by…, horizon, n, mean_abn). Horizons without a single return stay, as n = 0.

    Every horizon is summed in the same pass, so rows are not multiplied.
    """
    labels = list(horizons or HORIZONS)
    sums = []
    for h in labels:
        sums.append(F.count(f"abn_{h}").alias(f"n_{h}"))
        sums.append(F.avg(f"abn_{h}").alias(f"mean_{h}"))
    wide = panel.groupBy(*by).agg(*sums) if by else panel.agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"),
                F.col(f"n_{h}").alias("n"),
                F.col(f"mean_{h}").alias("mean_abn"),
            )
            for h in labels
        ]
    )
    return wide.select(*by, F.inline(rows))


def horizon_curve(
    panel: DataFrame,
    horizons: Sequence[str] | None = None,
    n_boot: int = 10_000,
    seed: int = 0,
    by: Sequence[str] = (),
    lo: float = 2.5,
    hi: float = 97.5,
) -> DataFrame:
    """(by…, horizon, n, mean_abn, ci_lo, ci_hi) with exact bootstrap intervals.

    The panel is read several times; hand over a stored or checkpointed one.
    """
    groups = [*by, "horizon"]
    rows = long_returns(panel, horizons, keep=by)
    means = bootstrap.resampled_means(rows, "abn", groups, n_boot, seed)
    interval = bootstrap.percentile_interval(means, groups, n_boot, lo, hi)
    return _attach(horizon_means(panel, horizons, by), interval, groups)


def poisson_curve(
    panel: DataFrame,
    horizons: Sequence[str] | None = None,
    n_boot: int = 200,
    by: Sequence[str] = (),
    lo: float = 2.5,
    hi: float = 97.5,
) -> DataFrame:
    """The same curve with Poisson bootstrap intervals, whose weights follow from the event's key."""
    labels = list(horizons or HORIZONS)
    groups = [*by, "horizon"]
    wide = bootstrap.poisson_means(panel, [f"abn_{h}" for h in labels], EVENT_KEY, by, n_boot)
    means = wide.unpivot(
        [*by, "replicate"], [f"mean_abn_{h}" for h in labels], "horizon", "mean"
    ).withColumn("horizon", F.replace("horizon", F.lit("mean_abn_"), F.lit("")))
    interval = bootstrap.percentile_interval(
        means.filter(F.col("mean").isNotNull()), groups, n_boot, lo, hi
    )
    return _attach(horizon_means(panel, labels, by), interval, groups)


def _attach(curve: DataFrame, interval: DataFrame, groups: Sequence[str]) -> DataFrame:
    joined = curve
    renamed = interval.select(*[F.col(g).alias(f"ci_{g}") for g in groups], "ci_lo", "ci_hi")
    same = [F.col(g).eqNullSafe(F.col(f"ci_{g}")) for g in groups]
    return joined.join(renamed, same, "left").select(*groups, "n", "mean_abn", "ci_lo", "ci_hi")


def verdict() -> Column:
    """What one horizon's interval says about drift."""
    return (
        F.when(F.col("mean_abn").isNull(), "no data")
        .when(F.col("ci_lo") > 0, "positive")
        .when(F.col("ci_hi") < 0, "negative")
        .otherwise("includes 0")
    )


def with_verdicts(curve: DataFrame) -> DataFrame:
    return curve.withColumn("verdict", verdict())


def gate(curve: DataFrame) -> DataFrame:
    """Go on only if some horizon's interval clears zero from above."""
    go = F.coalesce(F.bool_or(F.col("ci_lo") > 0), F.lit(False))
    return curve.agg(
        go.alias("any_positive"), F.when(go, "continue").otherwise("stop").alias("decision")
    )


def coverage(panel: DataFrame) -> DataFrame:
    """Priced share of the events: the part of the population the curve can speak for."""
    return panel.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if("priced").alias("n_priced"),
        F.avg(F.col("priced").cast("double")).alias("coverage"),
    )
