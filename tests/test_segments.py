from __future__ import annotations

import datetime as dt
import random
import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import medians, segments

DAY0 = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def trades():
    """600 trades; one insider and one issuer stand behind a third of them."""
    rng = random.Random(5)
    out = []
    for i in range(600):
        hot = rng.random() < 1 / 3
        out.append(
            (
                f"a{i}", 1,
                "hot" if hot else f"i{rng.randrange(12)}",
                "HOT" if hot or rng.random() < 0.1 else f"c{rng.randrange(6)}",
                DAY0 + dt.timedelta(days=rng.randrange(1500)),
                None if rng.random() < 0.05 else float(rng.choice([10, 20, 20, rng.randrange(1, 500)])),
            )
        )
    return out


@pytest.fixture(scope="module")
def events(spark, trades):
    return spark.createDataFrame(
        trades,
        "accession string, txn_sk int, insider_id string, issuer_cik string, filing_date date, value double",
    )


def by_key(df, column):
    return {r.accession: r[column] for r in df.collect()}


def prior_median(trades, insider, day):
    seen = [v for _, _, i, _, d, v in trades if i == insider and d < day and v is not None]
    return statistics.median(seen) if seen else None


@pytest.mark.parametrize(
    "limits", [{}, {"window_rows": 30}, {"window_rows": 30, "bucket_rows": 1}, {"window_rows": 0, "bucket_rows": 7}]
)
def test_prior_median_on_every_route(events, trades, limits):
    """Window only, busy insiders in one bucket, and in many: all equal brute force."""
    got = by_key(medians.with_own_size(events, **limits), "prior_median")
    for a, _, i, _, d, _ in trades:
        assert got[a] == prior_median(trades, i, d)


def test_prior_median_with_one_repeated_value_and_one_day(spark):
    same = [(f"a{i}", 1, "x", DAY0 + dt.timedelta(days=i % 3), 5.0) for i in range(50)]
    df = spark.createDataFrame(same, "accession string, txn_sk int, insider_id string, filing_date date, value double")
    got = {r.filing_date: r.prior_median for r in medians.prior_medians(df, window_rows=10, bucket_rows=4).collect()}
    assert got == {DAY0: None, DAY0 + dt.timedelta(1): 5.0, DAY0 + dt.timedelta(2): 5.0}


def test_prior_median_of_a_busy_insider_without_values(spark):
    none = [(f"a{i}", 1, "x", DAY0 + dt.timedelta(days=i), None) for i in range(20)]
    df = spark.createDataFrame(none, "accession string, txn_sk int, insider_id string, filing_date date, value double")
    out = medians.prior_medians(df, window_rows=10)
    assert out.count() == 20 and out.filter("prior_median IS NOT NULL").count() == 0


@pytest.mark.parametrize("window", [0, 5, 30, 400])
def test_cluster_size_counts_distinct_insiders(events, trades, window):
    got = by_key(segments.with_cluster_size(events, window), "cluster_size")
    for a, _, _, c, d, _ in trades:
        want = {i for _, _, i, cc, dd, _ in trades if cc == c and d - dt.timedelta(window) <= dd <= d}
        assert got[a] == len(want)


def test_routine_needs_every_prior_year(events, trades):
    got = by_key(segments.with_routine_flag(events, 2), "is_routine")
    months = {(i, d.year, d.month) for _, _, i, _, d, _ in trades}
    for a, _, i, _, d, _ in trades:
        assert got[a] == all((i, d.year - k, d.month) in months for k in (1, 2))


def test_later_filings_change_no_earlier_feature(spark, events):
    cut = DAY0 + dt.timedelta(days=700)
    past = events.filter(F.col("filing_date") <= F.lit(cut))

    def features(df):
        wide = segments.with_routine_flag(segments.with_cluster_size(medians.with_own_size(df)), 1)
        keep = wide.filter(F.col("filing_date") <= F.lit(cut))
        return rows(keep.select("accession", "prior_median", "cluster_size", "is_routine"), "accession")

    assert features(events) == features(past)


def test_features_do_not_depend_on_partitioning(events):
    pick = lambda df: rows(segments.with_cluster_size(df).select("accession", "cluster_size"), "accession")
    assert pick(events.repartition(11)) == pick(events.coalesce(1).orderBy(F.desc("value")))


def test_missing_days_and_insiders(spark):
    df = spark.createDataFrame(
        [("a", 1, None, "c", DAY0, 1.0), ("b", 1, "i", "c", None, 1.0), ("d", 1, "i", "c", DAY0, 1.0)],
        "accession string, txn_sk int, insider_id string, issuer_cik string, filing_date date, value double",
    )
    assert by_key(segments.with_cluster_size(df), "cluster_size") == {"a": 1, "b": None, "d": 1}
    assert by_key(segments.with_routine_flag(df), "is_routine") == {"a": False, "b": False, "d": False}
    assert by_key(medians.with_own_size(df), "prior_median") == {"a": None, "b": None, "d": None}


def test_size_is_the_latest_known_on_the_day(spark):
    ev = spark.createDataFrame(
        [("a", "c", DAY0, 10.0), ("b", "c", DAY0 + dt.timedelta(5), 10.0), ("d", "c", DAY0 - dt.timedelta(1), 10.0),
         ("e", "other", DAY0, 10.0), ("f", "c", None, 10.0)],
        "accession string, issuer_cik string, filing_date date, value double",
    )
    caps = spark.createDataFrame(
        [("c", DAY0, 1e8), ("c", DAY0 + dt.timedelta(3), 5e9), ("c", DAY0 + dt.timedelta(9), 9e12)],
        "issuer_cik string, effective_date date, market_cap double",
    )
    out = segments.with_market_cap(ev, caps)
    assert by_key(out, "cap_band") == {"a": "micro", "b": "mid", "d": "unknown", "e": "unknown", "f": "unknown"}
    assert by_key(out, "value_vs_company")["a"] == pytest.approx(1e-7)


def test_role_bucket_prefers_the_top_offices(spark):
    df = spark.createDataFrame(
        [("Chief Executive Officer", True, False), ("Interim CFO", True, False), ("Ceonic sales", True, False),
         (None, False, True), (None, False, False)],
        "title string, is_director boolean, is_ten_percent_owner boolean",
    ).coalesce(1)
    got = [r.role_bucket for r in segments.with_role_bucket(df).collect()]
    assert got == ["CEO", "CFO", "Director", "10% owner", "Other"]
