"""The horizon study: eligible events, their prices, the panel and its curve."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import signals
from tidemark.operators import sample as sampling
from tidemark.operators.sessions import trading_calendar
from tidemark.plans import curve as curves
from tidemark.plans.panel import abnormal_returns
from tidemark.schemas import EVENT_KEY
from tidemark.session import materialize
from tidemark.sources.prices import daily_closes, study_window


@dataclass(frozen=True)
class Study:
    """A study's tables; ``coverage`` holds n_events, n_priced and the ratio in one row."""

    panel: DataFrame
    curve: DataFrame
    coverage: DataFrame


def study_panel(
    events: DataFrame,
    prices: DataFrame,
    benchmark: DataFrame,
    sample: int | None = None,
    seed: int = 1,
    delistings: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Panel of all eligible events, or of a draw of ``sample`` of them, over the price window they need.

    What the panel needs of the chosen events is stored once: the window, the tickers and the panel read that.
    """
    kept = dict.fromkeys([*EVENT_KEY, "ticker", "filing_date", *(c for c in options.get("carry", ()) if c != "entry_t")])
    chosen = materialize(sampling.seeded_sample(signals.eligible_events(events).select(*kept), sample, seed))
    first, last = study_window(chosen)
    closes = daily_closes(prices, chosen, first, last)
    market = benchmark.filter(F.col("date").between(first, last))
    return abnormal_returns(
        chosen, closes, market, trading_calendar(market), delistings=delistings, **options
    )


def run_study(
    events: DataFrame,
    prices: DataFrame,
    benchmark: DataFrame,
    sample: int | None = None,
    seed: int = 1,
    n_boot: int = 10_000,
    delistings: DataFrame | None = None,
    **options,
) -> Study:
    """Curve, coverage and panel; the panel is checkpointed once and read by everything else."""
    panel = materialize(study_panel(events, prices, benchmark, sample, seed, delistings, **options))
    return Study(panel, curves.horizon_curve(panel, n_boot=n_boot), curves.coverage(panel))
