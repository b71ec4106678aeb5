from __future__ import annotations

import datetime as dt
import math

import pytest
from conftest import rows, weekdays
from pyspark.sql import functions as F

from tidemark.operators import basket


def path(spark, closes, ticker="T"):
    return spark.createDataFrame(
        [(ticker, t, c) for t, c in enumerate(closes) if c is not None], "ticker string, t long, close double"
    )


def exits(spark, closes, hold, **rules):
    return rows(basket.exit_overlays(path(spark, closes), hold, **rules), "entry_t")[0]


def test_stop_fills_at_the_next_print_however_low(spark):
    got = exits(spark, [10.0, 12.0, 10.5, 6.0, 9.0, 9.0], 5, activate=0.1, trail=0.1)
    assert got["stopped"] and got["trailing_stop"] == pytest.approx(-0.4)
    assert got["fixed"] == pytest.approx(-0.1)


def test_stop_waits_until_it_is_armed(spark):
    got = exits(spark, [10.0, 10.5, 8.0, 7.0, 9.0, 9.5], 5, activate=0.1, trail=0.1)
    assert not got["stopped"] and got["trailing_stop"] == got["fixed"] == pytest.approx(-0.05)


def test_stop_skips_sessions_without_a_print(spark):
    got = exits(spark, [10.0, 12.0, 10.0, None, None, 9.9, 11.0], 6, activate=0.1, trail=0.1)
    assert got["trailing_stop"] == pytest.approx(-0.01)


def test_a_stop_that_never_fills_is_unknown(spark):
    got = exits(spark, [10.0, 12.0, 10.0], 2, activate=0.1, trail=0.1)
    assert got["stopped"] and got["trailing_stop"] is None and got["fixed"] == pytest.approx(0.0)


def test_scale_out_sells_half_on_a_double(spark):
    got = exits(spark, [10.0, 20.0, 22.0, 24.0, 26.0, 25.0], 5, wide_trail=0.3)
    assert got["doubled"] and got["scale_out"] == pytest.approx((1.2 + 1.5) / 2)
    rest = exits(spark, [10.0, 20.0, 22.0, 15.0, 14.0, 30.0], 5, wide_trail=0.3)
    assert rest["scale_out"] == pytest.approx((1.2 + 0.4) / 2)
    assert exits(spark, [10.0, 11.0, 12.0], 2, wide_trail=0.3)["scale_out"] == pytest.approx(0.2)


def test_fixed_hold_needs_a_price_on_its_own_session(spark):
    assert exits(spark, [10.0, 11.0, None, 12.0], 2)["fixed"] is None


def test_exit_report_weighs_crowded_sessions(spark):
    overlays = spark.createDataFrame(
        [("T", 0, 0.1, 0.2, None), ("U", 0, -0.2, 0.1, None)],
        "ticker string, entry_t long, fixed double, trailing_stop double, scale_out double",
    )
    entries = spark.createDataFrame([("T", 0)] * 3 + [("U", 0), ("V", 0)], "ticker string, entry_t long")
    counted = basket.entry_counts(entries)
    got = {r.rule: r for r in basket.exit_report(counted, overlays).collect()}
    assert got["fixed"].n == 4 and got["fixed"].mean == pytest.approx(0.025) and got["fixed"].hit_rate == 0.75
    assert got["scale_out"].n == 0 and got["scale_out"].mean is None


def test_only_entered_sessions_are_walked(spark):
    px = path(spark, [10.0, 12.0, 10.5, 6.0, 9.0, 9.0])
    entries = spark.createDataFrame([("T", 1), ("NOPE", 0)], "ticker string, entry_t long")
    [one] = rows(basket.exit_overlays(px, 3, entries=entries), "entry_t")
    assert one == rows(basket.exit_overlays(px, 3), "entry_t")[1]


def trades(spark, data):
    return spark.createDataFrame(data, "entry_date date, r double, adv double")


def test_performance_of_a_known_series(spark):
    data = [(dt.date(2020, m, 3), r, 1000.0) for m, r in ((1, 0.1), (2, -0.2), (3, 0.05))]
    data.append((dt.date(2020, 1, 9), 0.3, None))
    got = basket.performance(trades(spark, data), "r").first()
    months = [0.2, -0.2, 0.05]
    assert (got.months, got.trades, got.hit_rate) == (3, 4, 0.75)
    assert got.cagr == pytest.approx(math.prod(1 + r for r in months) ** 4 - 1)
    assert got.max_drawdown == pytest.approx(-0.2)
    mean = sum(months) / 3
    sd = math.sqrt(sum((r - mean) ** 2 for r in months) / 2)
    assert got.sharpe == pytest.approx(mean / sd * math.sqrt(12))
    assert got.capacity == pytest.approx(10.0) and got.turnover == pytest.approx(4 / 3)


def test_a_losing_first_month_is_a_drawdown_and_a_wipe_out_ends_at_zero(spark):
    data = [(dt.date(2020, 1, 3), -0.5, None), (dt.date(2020, 2, 3), -1.0, None)]
    got = basket.performance(trades(spark, data), "r").first()
    assert got.max_drawdown == -1.0 and got.cagr == -1.0


def test_cost_grows_with_illiquidity_and_size(spark):
    cost = lambda adv, size: spark.range(1).select(
        basket.trading_cost(F.lit(adv).cast("double"), size).alias("c")
    ).first().c
    assert cost(None, 1e4) > cost(4e4, 1e4) > cost(1e5, 1e4) > cost(5e5, 1e4) > cost(5e6, 1e4)
    assert cost(5e6, 1e5) > cost(5e6, 1e4)
    assert cost(0.0, 1e4) == cost(None, 1e4)


def test_walk_forward_trains_on_settled_years_only(spark):
    days = [dt.date(2018, 6, 1), dt.date(2018, 12, 20), dt.date(2019, 3, 1), dt.date(2021, 1, 5)]
    df = spark.createDataFrame([(d, float(i), None) for i, d in enumerate(days)], "entry_date date, r double, adv double")
    got = {(r["fold"], r["side"]): (r["n"], r["mean"]) for r in rows(basket.walk_forward(df, "r", 30), "fold", "side")}
    assert got[(2018, "test")] == (2, 0.5)
    assert got[(2019, "train")] == (1, 0.0) and got[(2019, "test")] == (1, 2.0)
    assert got[(2020, "train")] == (3, 1.0) and (2020, "test") not in got
    assert got[(2021, "train")] == (3, 1.0) and got[(2021, "test")] == (1, 3.0)


def test_time_split_keeps_open_trades_out(spark):
    days = [dt.date(2018, 6, 1), dt.date(2018, 12, 20), dt.date(2019, 1, 1)]
    df = spark.createDataFrame([(d, 1.0) for d in days], "entry_date date, r double")
    got = {r.side: r.n for r in basket.time_split(df, "r", dt.date(2019, 1, 1), 30).collect()}
    assert got == {"train": 1, "test": 1}


def test_pooling_trusts_insiders_with_more_trades(spark):
    data = [("s", "busy", 1.0 + 0.1 * (i % 3)) for i in range(60)]
    data += [("s", "new", 1.0), ("s", "new", 1.2), ("s", "low", -1.0), ("s", "low", -0.8), ("t", "solo", 0.4)]
    df = spark.createDataFrame(data, "role_bucket string, insider_id string, x double")
    got = {r.insider_id: r for r in basket.partial_pooling(df, "x").collect()}
    pull = lambda r: (r.own_mean - r.estimate) / (r.own_mean - r.segment_mean)
    assert 0 <= pull(got["busy"]) < pull(got["new"]) < 1
    assert got["solo"].estimate == got["solo"].segment_mean == pytest.approx(0.4)


def test_pooling_without_differences_gives_the_segment_mean(spark):
    data = [("s", i, v) for i in ("a", "b") for v in (0.0, 1.0, 2.0)]
    df = spark.createDataFrame(data, "role_bucket string, insider_id string, x double")
    assert {r.estimate for r in basket.partial_pooling(df, "x").collect()} == {1.0}


def test_folds_of_any_shape(spark):
    """Overlapping, empty, open-ended and back-to-front sides, against a plain count."""
    first = dt.date(2020, 1, 1)
    panel = [(first + dt.timedelta(days=(i * i) % 97), None if i % 11 == 0 else i / 7) for i in range(300)] + [(None, 1.0)]
    folds = [(k, s, first + dt.timedelta(days=a), first + dt.timedelta(days=b)) for k in range(40) for s, a, b in (("train", k - 30, k), ("test", k + 5, k + 20 + k % 7))]
    folds += [(90, "all", dt.date(1990, 1, 1), dt.date(2050, 1, 1)), (91, "before", dt.date(1990, 1, 1), first), (92, "after", dt.date(2030, 1, 1), dt.date(2031, 1, 1)), (93, "empty", first, first)]
    got = basket.fold_means(
        spark.createDataFrame(panel, "entry_date date, x double"), "x", spark.createDataFrame(folds, "fold int, side string, start date, end date")
    )
    found = {(r.fold, r.side): (r.n, r.mean) for r in got.collect()}
    assert len(found) == len(folds)
    for k, side, a, b in folds:
        own = [x for d, x in panel if d is not None and x is not None and a <= d < b]
        assert found[k, side][0] == len(own)
        assert found[k, side][1] == (pytest.approx(sum(own) / len(own), abs=1e-9) if own else None)
    empty = basket.fold_means(spark.createDataFrame([], "entry_date date, x double"), "x", spark.createDataFrame(folds[:2], "fold int, side string, start date, end date"))
    assert [(r.n, r.mean) for r in empty.collect()] == [(0, None)] * 2


def ended(spark, closes, delist, hold, **rules):
    """Exit rules over one ticker's closes by session (weekdays from 2020-01-06) with delistings {session: recovery}."""
    days = weekdays(dt.date(2020, 1, 6), len(closes) + 5)
    px = spark.createDataFrame([("T", t, c, days[t]) for t, c in enumerate(closes) if c is not None], "ticker string, t long, close double, cal_date date")
    gone = spark.createDataFrame([("T", days[t] if isinstance(t, int) else t, r) for t, r in delist.items()], "ticker string, delist_date date, recovery_value double")
    calendar = spark.createDataFrame([(d,) for d in days], "date date")
    return {r["entry_t"]: r for r in rows(basket.exit_overlays(basket.terminal_prints(px, gone, calendar), hold, **rules), "entry_t")}


def test_a_delisting_ends_the_path_at_its_recovery(spark):
    got = ended(spark, [10.0, 11.0, 10.8], {4: 2.0}, 10)
    assert got[0]["fixed"] == got[0]["scale_out"] == pytest.approx(-0.8) and got[0]["trailing_stop"] == pytest.approx(-0.8)
    assert got[0]["stopped"] and set(got) == {0, 1, 2}
    assert ended(spark, [10.0, 11.0, 10.8], {}, 10)[0]["fixed"] is None


def test_a_stop_before_the_delisting_fills_at_the_next_print(spark):
    got = ended(spark, [10.0, 12.0, 10.5, 9.0], {5: 0.0}, 10)
    assert got[0]["trailing_stop"] == pytest.approx(-0.1) and got[0]["fixed"] == pytest.approx(-1.0)
    last = ended(spark, [10.0, 12.0, 10.5], {5: 4.0}, 10)  # the order of the last print fills at what is recovered
    assert last[0]["trailing_stop"] == pytest.approx(-0.6)


def test_a_hold_that_ends_before_the_delisting_keeps_its_price(spark):
    got = ended(spark, [10.0, 11.0, 12.0, 13.0], {4: 0.0}, 2)
    assert got[0]["fixed"] == pytest.approx(0.2) and got[1]["fixed"] == pytest.approx(2 / 11) and got[2]["fixed"] == pytest.approx(-1.0)


def test_a_reused_ticker_starts_a_life_of_its_own(spark):
    got = ended(spark, [10.0, 11.0, 40.0, 44.0, 48.0], {2: 1.0, 4: 6.0}, 3)
    assert got[0]["fixed"] == pytest.approx(-0.9) and not got[0]["doubled"]  # the next life's prices are not its own
    assert got[2]["fixed"] == pytest.approx(6 / 40 - 1) and got[4]["fixed"] is None
    weekend = ended(spark, [10.0, 11.0, 12.0, 12.0, 12.0, 30.0], {dt.date(2020, 1, 11): 5.0}, 5)  # a Saturday: paid on Monday, session 5
    assert weekend[0]["fixed"] == pytest.approx(-0.5) and weekend[5]["fixed"] is None and weekend[1]["fixed"] == pytest.approx(5 / 11 - 1)


def test_spreads_of_the_version_in_force(spark):
    costs = [(dt.date(2020, 1, 1), 0.0, 0.05), (dt.date(2020, 1, 1), 100.0, 0.03), (dt.date(2020, 1, 1), 1000.0, 0.01), (dt.date(2021, 7, 1), 10.0, 0.04), (dt.date(2021, 7, 1), 5e12, 0.001)]
    adv = [None, -1.0, 0.0, 0.5, 1.0, 9.99, 10.0, 64.0, 99.999, 100.0, 127.9, 128.0, 999.9, 1000.0, 1e9, 5e12, 1e300, float("inf")]
    days = [dt.date(2019, 12, 31), dt.date(2020, 1, 1), dt.date(2021, 6, 30), dt.date(2021, 7, 1), dt.date(2050, 1, 1), None]
    trades = [(i, d, a) for i, (d, a) in enumerate((d, a) for d in days for a in adv)] * 2
    got = basket.with_spreads(
        spark.createDataFrame(trades, "k int, entry_date date, adv double"), spark.createDataFrame(costs, "effective_date date, min_adv double, spread double")
    )

    def expected(d, a):
        since = max((v for v, _, _ in costs if d is not None and v <= d), default=None)
        steps = sorted((low, s) for v, low, s in costs if v == since)
        return max(((low, s) for low, s in steps if a is not None and a >= low), default=steps[0])[1] if steps else None

    found = got.collect()
    assert len(found) == len(trades) and all(r.spread == expected(r.entry_date, r.adv) for r in found)
