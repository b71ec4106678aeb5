"""Permanent ids and size-matched benchmarks."""

from __future__ import annotations

import datetime as dt
import random
import statistics

import pytest
from conftest import weekdays
from pyspark.sql import functions as F

from tidemark.operators import listings
from tidemark.plans import matched

LISTED = "ticker string, permanent_id string, valid_from date, valid_to date"


def on(y, m=1, d=1):
    return dt.date(y, m, d)


@pytest.fixture
def known(spark):
    lives = [
        ("AAA", "1", on(2000), on(2005, 6, 15)), ("AAA", "2", on(2005, 6, 15), on(2010)), ("AAA", "3", on(2012), None),
        ("BBB", "4", on(2000), on(2003)), ("CCC", "4", on(2003), None), ("AAA", "1", on(2000), on(2005, 6, 15)),
    ]
    return spark.createDataFrame(lives, LISTED)


def test_a_ticker_names_what_it_stood_for_on_the_day(spark, known):
    asked = [("AAA", on(1999, 12, 31)), ("AAA", on(2000)), ("AAA", on(2005, 6, 14)), ("AAA", on(2005, 6, 15)), ("AAA", on(2011)), ("AAA", on(2090)), ("BBB", on(2002)), ("CCC", on(2003)), ("CCC", on(2002)), ("ZZZ", on(2002)), (None, on(2002)), ("AAA", None)]
    df = spark.createDataFrame([(*a, "kept") for a in asked] * 2, "ticker string, day date, other string")
    got = listings.with_permanent_id(df, known, "day")
    assert got.columns == ["ticker", "day", "other", "permanent_id"] and got.count() == 2 * len(asked)
    found = {(r.ticker, r.day): r.permanent_id for r in got.collect()}
    assert [found[a] for a in asked] == [None, "1", "1", "2", None, "3", "4", "4", None, None, None, None]
    assert {r.ticker for r in listings.by_permanent_id(df, known, "day").collect()} == {None, "1", "2", "3", "4"}


def test_no_range_join(spark, known):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).select(F.lit("AAA").alias("ticker"), F.date_add(F.lit(on(2001)), F.col("id").cast("int")).alias("day"))
        text = listings.with_permanent_id(df, known, "day")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "NestedLoop" not in text and "Cartesian" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_overlaps_are_reported(spark, known):
    assert listings.overlapping_listings(known).count() == 0
    more = known.unionByName(spark.createDataFrame([("AAA", "9", on(2009), on(2012, 2)), ("DDD", "9", on(2009), None)], LISTED))
    assert {(r.ticker, r.one, r.other) for r in listings.overlapping_listings(more).collect()} == {("AAA", "2", "9"), ("AAA", "9", "3")}


def test_bands_follow_the_size_known_at_the_months_start(spark):
    sizes = [("A", on(2020, 1, 1), 1.0), ("B", on(2020, 1, 1), 2.0), ("C", on(2020, 1, 1), 3.0), ("A", on(2020, 2, 10), 9.0), ("A", on(2020, 2, 20), 10.0), ("D", on(2020, 3, 2), None), (None, on(2020, 1, 1), 5.0)]
    got = matched.monthly_bands(spark.createDataFrame(sizes, "ticker string, effective_date date, size double"), on(2020, 4, 17), 3)
    found = {(r.ticker, r.month.month): r.band for r in got.collect()}
    assert found == {**{(t, m): b for m in (1, 2) for t, b in (("A", 1), ("B", 2), ("C", 3))}, **{(t, m): b for m in (3, 4) for t, b in (("A", 3), ("B", 1), ("C", 2))}}


def test_size_matched_returns_equal_brute_force(spark):
    rng = random.Random(3)
    days = weekdays(on(2020), 70)
    names = [f"T{k}" for k in range(9)]
    prices = {(n, t): rng.uniform(5, 50) for n in names for t in range(70) if rng.random() < 0.9}
    sizes = [(n, on(2020, m, 1), rng.uniform(1, 100)) for n in names[:8] for m in (1, 2, 3)]
    events = [(f"a{i}", 1, rng.choice([*names, "none"]), rng.choice(days + [dt.date(2020, 1, 4), None])) for i in range(150)]
    got = matched.size_matched_returns(
        spark.createDataFrame(events, "accession string, txn_sk long, ticker string, filing_date date"),
        spark.createDataFrame([(n, days[t], c) for (n, t), c in prices.items()], "ticker string, date date, close double"),
        spark.createDataFrame([(d, 1.0) for d in days], "date date, close double"),
        spark.createDataFrame(sizes, "ticker string, effective_date date, size double"), horizons={"1w": 5},
    )
    band = {}
    for m in (1, 2, 3, 4):
        known = {n: s for n, d, s in sizes if d == on(2020, min(m, 3), 1)}
        cuts = statistics.quantiles(known.values(), n=3, method="inclusive")
        band.update({(n, m): 1 + sum(c < s for c in cuts) for n, s in known.items()})

    def ret(n, t):
        return prices[n, t + 5] / prices[n, t] - 1 if (n, t) in prices and (n, t + 5) in prices else None

    found = {r.accession: r for r in got.collect()}
    assert len(found) == len(events)
    for a, _, n, filed in events:
        t = next((k for k, d in enumerate(days) if filed is not None and d >= filed), None)
        r, own = found[a], ret(n, t) if t is not None else None
        place = band.get((n, days[t].month)) if t is not None and (n, t) in prices else None
        assert r.band == place and (r.ret_1w == pytest.approx(own) if own is not None else r.ret_1w is None)
        if own is not None and place is not None:
            peers = [x for m in names if band.get((m, days[t].month)) == place and (x := ret(m, t)) is not None]
            assert r.abn_1w == pytest.approx(own - sum(peers) / len(peers))
        else:
            assert r.abn_1w is None


def test_thin_groups_fall_back_to_the_sector(spark):
    rng = random.Random(8)
    days = weekdays(on(2020), 45)
    names = [f"T{k}" for k in range(16)]
    prices = {(n, t): rng.uniform(5, 50) for n in names for t in range(45) if rng.random() < 0.8}
    sectors = [(n, on(2019, 6, 3), "x" if k < 9 else "y" if k < 14 else None) for k, n in enumerate(names)] + [("T0", on(2020, 2, 3), "y")]
    sizes = [(n, on(2020, 1, 1), float(k * 7 % 16)) for k, n in enumerate(names) if k != 3]
    events = [(f"a{i}", n, d) for i, (n, d) in enumerate((n, d) for n in [*names, "none"] for d in days)]
    got = matched.sector_matched_returns(
        spark.createDataFrame([(a, 1, n, d) for a, n, d in events], "accession string, txn_sk long, ticker string, filing_date date"),
        spark.createDataFrame([(n, days[t], c) for (n, t), c in prices.items()], "ticker string, date date, close double"),
        spark.createDataFrame([(d, 1.0) for d in days], "date date, close double"),
        spark.createDataFrame(sectors, "ticker string, effective_date date, sector string"),
        spark.createDataFrame(sizes, "ticker string, effective_date date, size double"), bands=2, min_names=3, horizons={"1w": 5},
    )
    middle = statistics.median(s for _, _, s in sizes)
    band = {n: 1 + (s > middle) for n, _, s in sizes}

    def sector(n, t):
        first = dict((m, s) for m, _, s in sectors[:-1])[n]
        return "y" if n == "T0" and days[t].month > 2 else first  # known on 3 February, in force from March

    def ret(n, t):
        return prices[n, t + 5] / prices[n, t] - 1 if (n, t) in prices and (n, t + 5) in prices else None

    found, used = {r.accession: r for r in got.collect()}, set()
    assert len(found) == len(events)
    for a, n, day in events:
        t, r = days.index(day), found[a]
        own = ret(n, t) if n != "none" else None
        if own is None or sector(n, t) is None:
            assert r.abn_1w is None
            continue
        peers = {m: x for m in names if sector(m, t) == sector(n, t) and (x := ret(m, t)) is not None}
        close = [x for m, x in peers.items() if n in band and band.get(m) == band[n]]
        group = close if len(close) >= 3 else list(peers.values()) if len(peers) >= 3 else None
        used.add("none" if group is None else "band" if group is close else "sector")
        assert (r.sector, r.band) == (sector(n, t), band.get(n))
        assert r.abn_1w == (pytest.approx(own - sum(group) / len(group)) if group else None)
    assert {"band", "sector"} <= used
