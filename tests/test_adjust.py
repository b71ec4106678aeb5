from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import rows, weekdays

from tidemark.operators import adjust

DAYS = weekdays(dt.date(2021, 3, 1), 12)
PRICES = "ticker string, date date, open double, close double, volume double"
ACTIONS = "ticker string, ex_date date, split double, dividend double"


def adjusted(spark, prices, actions, **options):
    return rows(adjust.adjusted_prices(spark.createDataFrame(prices, PRICES), spark.createDataFrame(actions, ACTIONS), **options), "ticker", "date", "close")


def flat(ticker="T", close=100.0, n=6):
    return [(ticker, d, close, close, 10.0) for d in DAYS[:n]]


def test_a_split_divides_what_came_before(spark):
    got = adjusted(spark, flat(), [("T", DAYS[3], 4.0, None)])
    assert [r["close"] for r in got] == [25.0] * 3 + [100.0] * 3
    assert [r["volume"] for r in got] == [40.0] * 3 + [10.0] * 3
    assert [r["factor"] for r in got] == [0.25] * 3 + [1.0] * 3


def test_a_dividend_makes_total_returns(spark):
    prices = [("T", DAYS[0], 99.0, 100.0, 1.0), ("T", DAYS[1], 95.0, 95.0, 1.0)]
    first, second = adjusted(spark, prices, [("T", DAYS[1], None, 5.0)])
    assert second["close"] / first["close"] == pytest.approx(1.0) and first["volume"] == 1.0
    assert adjusted(spark, prices, [("T", DAYS[1], None, 5.0)], dividends=False)[0]["close"] == 100.0


def test_actions_without_a_print_and_outside_the_prices(spark):
    saturday = dt.date(2021, 3, 6)
    actions = [("T", saturday, 2.0, None), ("T", dt.date(2020, 1, 1), 3.0, 7.0), ("T", dt.date(2030, 1, 1), 10.0, None), ("U", DAYS[2], 2.0, 1.0)]
    got = adjusted(spark, flat(n=7), actions)
    assert [r["close"] for r in got] == pytest.approx([5.0] * 5 + [10.0] * 2)  # 5 March is a Friday; the future split counts for all


def test_odd_actions(spark):
    actions = [(None, DAYS[2], 2.0, 1.0), ("T", None, 2.0, 1.0), ("T", DAYS[2], 0.0, -1.0), ("T", DAYS[2], -2.0, None), ("T", DAYS[4], None, 100.0)]
    prices = [*flat(), (None, DAYS[0], 1.0, 1.0, 1.0), ("T", None, 1.0, 1.0, 1.0)]
    assert [r["factor"] for r in adjusted(spark, prices, actions)] == [1.0] * 6
    [wrong] = rows(adjust.unbooked_dividends(spark.createDataFrame(prices, PRICES), spark.createDataFrame(actions, ACTIONS)), "date")
    assert wrong == {"ticker": "T", "date": DAYS[4], "dividend": 100.0, "last_close": 100.0}
    assert adjusted(spark, [], actions) == [] and [r["close"] for r in adjusted(spark, flat(), [])] == [100.0] * 6


def test_repeated_prints_and_missing_closes(spark):
    prices = [("T", DAYS[0], 1.0, 80.0, None), ("T", DAYS[0], 1.0, 50.0, 1.0), ("T", DAYS[1], 1.0, None, 1.0), ("T", DAYS[2], None, 40.0, 1.0)]
    got = adjusted(spark, prices, [("T", DAYS[2], None, 10.0)])  # 10 of the lowest last close, 50
    assert len(got) == 4 and sorted(r["close"] or 0 for r in got) == pytest.approx([0, 40.0, 40.0, 64.0])
    assert [r["open"] for r in got if r["open"] is not None] == pytest.approx([0.8] * 3)


def test_against_each_price_and_its_later_actions(spark):
    rng = random.Random(5)
    days = weekdays(dt.date(2021, 1, 4), 120)
    prices = [(k, d, p, p * 1.01, 5.0) for k in "AB" for d in days if rng.random() < 0.7 for p in [rng.uniform(20, 90)]]
    actions = [(rng.choice("AB"), dt.date(2021, 1, 1) + dt.timedelta(days=rng.randrange(180)), rng.choice([None, 2.0, 0.1]), rng.choice([None, 0.5, 3.0])) for _ in range(40)]
    closes = {(k, d): c for k, d, _, c, _ in prices}
    by_day = {}
    for k, d, s, x in actions:
        split, paid = by_day.get((k, d), (1.0, 0.0))
        by_day[k, d] = split * (s or 1.0), paid + (x or 0.0)
    for r in adjusted(spark, prices, actions):
        factor, shares = 1.0, 1.0
        for (k, d), (split, paid) in by_day.items():
            if k == r["ticker"] and d > r["date"]:
                last = closes[k, max(day for key, day in closes if key == k and day < d)]
                factor *= (1 - paid / last) / split
                shares *= split
        assert r["factor"] == pytest.approx(factor) and r["volume"] == pytest.approx(5.0 * shares)
        assert r["close"] == pytest.approx(closes[r["ticker"], r["date"]] * factor)


def test_a_ticker_with_many_copies_of_its_rows(spark):
    days = spark.createDataFrame([("HOT", d, 10.0, 10.0, 1.0) for d in DAYS[:6]], PRICES)
    copies = days.crossJoin(spark.range(20_000)).drop("id")
    actions = spark.createDataFrame([("HOT", DAYS[3], 4.0, 1.0)], ACTIONS)
    got = adjust.adjusted_prices(copies, actions)
    assert rows(got.groupBy("date", "factor").count(), "date") == [{"date": d, "factor": 0.225 if i < 3 else 1.0, "count": 20_000} for i, d in enumerate(DAYS[:6])]
    plan = adjust._course(copies, actions)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(close" in plan  # copies fold before they travel
