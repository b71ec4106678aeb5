from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import signals
from tidemark.operators import sample


def column(df, name):
    return [r[name] for r in df.collect()]


def frame(spark, name, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}").coalesce(1)


def test_purchases_need_both_code_and_acquisition(spark):
    df = spark.createDataFrame(
        [("P", "A"), ("P", "D"), ("S", "A"), ("M", "A"), ("P", "A"), (None, "A"), ("P", None)],
        "TRANS_CODE string, TRANS_ACQUIRED_DISP_CD string",
    )
    kept = signals.open_market_purchases(df).collect()
    assert [tuple(r) for r in kept] == [("P", "A"), ("P", "A")]


def test_document_types_default_to_originals(spark):
    df = frame(spark, "document_type", ["4", "4/A", "3", None])
    assert column(signals.of_document_types(df), "document_type") == ["4"]
    assert column(signals.of_document_types(df, ("4", "4/A")), "document_type") == ["4", "4/A"]


def test_messy_flag_reads_every_spelling(spark):
    values = ["1", "true", "TRUE", "\tYes ", " y ", "T", "0", "false", "no", "", None]
    out = signals.with_planned_flag(frame(spark, "aff10b5one", values))
    assert column(out, "is_10b5_1") == [True] * 6 + [False] * 5


def test_messy_flag_without_its_column_is_false(spark):
    assert column(signals.with_planned_flag(spark.range(3)), "is_10b5_1") == [False] * 3


def test_roles_are_substring_flags(spark):
    df = frame(spark, "relationship", ["Officer,Director", "TenPercentOwner", "other", None])
    got = [tuple(r[f] for f in signals.ROLE_WORDS) for r in signals.with_role_flags(df).collect()]
    assert got == [
        (True, True, False, False),
        (False, False, True, False),
        (False, False, False, True),
        (False, False, False, False),
    ]


def test_planned_trades_drop_by_flag_and_keep_nulls(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, is_10b5_1 boolean")
    assert column(signals.drop_planned(df), "id") == [2, 3]


def test_planned_trades_drop_by_footnote_and_keep_nulls(spark):
    df = spark.createDataFrame(
        [(1, "under a 10B5-1 plan"), (2, "bought at market"), (3, None)], "id int, note string"
    )
    assert column(signals.drop_planned(df, footnote="note"), "id") == [2, 3]
    assert column(signals.drop_planned(df, footnote="absent"), "id") == [1, 2, 3]


def test_dates_parse_leniently(spark):
    df = frame(spark, "d", ["06-FEB-2024", "6-Feb-2024", "2024-02-06", "junk", "31-FEB-2024", None])
    day = dt.date(2024, 2, 6)
    assert column(df.select(signals.filing_day(F.col("d")).alias("d")), "d") == [
        day, day, None, None, None, None,
    ]


def test_ticker_rules(spark):
    df = frame(spark, "ticker", ["ABC", "BRK.B", "X-1", "A1", "", "...", "É", None])
    assert column(signals.eligible_events(df), "ticker") == ["ABC", "BRK.B", "..."]
    assert sorted(column(signals.requestable_tickers(df), "ticker")) == ["A1", "ABC", "BRK.B"]


def test_reliable_price_bounds(spark):
    df = spark.createDataFrame(
        [(1, False, 5.0), (2, True, 5.0), (3, False, 0.0), (4, False, 10_000.0), (5, False, None)],
        "id int, price_footnoted boolean, price double",
    )
    assert column(df.filter(signals.has_reliable_price()), "id") == [1]


def test_ciks_that_are_missing_or_no_numbers(spark):
    df = spark.createDataFrame([(None,), ("n/a",), ("7",)], "cik string").select(
        signals.padded_cik(F.col("cik")).alias("padded"), signals.filing_url(F.lit("0-1"), F.col("cik")).alias("url")
    )
    got = df.collect()
    assert [r.padded for r in got] == [None, None, "CIK0000000007"]
    assert got[0].url is None and "/n/a/" in got[1].url and "/7/" in got[2].url


def test_cik_forms_and_url(spark):
    row = spark.range(1).select(
        signals.padded_cik(F.lit("0000000042")).alias("padded"),
        signals.plain_cik(F.lit("0000000042")).alias("plain"),
        signals.plain_cik(F.lit("n/a")).alias("text"),
        signals.filing_url(F.lit("00-11-22"), F.lit("0042")).alias("url"),
    ).first()
    assert (row.padded, row.plain, row.text) == ("CIK0000000042", "42", "n/a")
    assert row.url == "https://www.sec.gov/Archives/edgar/data/42/001122/00-11-22-index.htm"


def test_sample_is_exact_and_independent_of_partitioning(spark):
    df = spark.range(500).select(
        F.concat(F.lit("A-"), F.col("id")).alias("accession"), F.lit(1).alias("txn_sk")
    )
    draw = lambda d, seed: {r.accession for r in sample.seeded_sample(d, 40, seed).collect()}
    one = draw(df, 1)
    assert len(one) == 40
    assert one == draw(df.repartition(7), 1)
    assert one != draw(df, 2)
    assert sample.seeded_sample(df, 0).count() == sample.seeded_sample(df, 10_000).count() == 500
