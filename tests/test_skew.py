"""A third of all rows behind one key: same answers, and the hot key is split."""

from __future__ import annotations

import datetime as dt
import statistics

import pytest
from conftest import rows, weekdays
from pyspark.sql import functions as F

from tidemark.operators import collapse, flatten, medians, segments
from tidemark.plans import events
from tidemark.plans.panel import abnormal_returns

DAYS = weekdays(dt.date(2019, 1, 7), 60)


@pytest.fixture
def eager_splits(spark):
    """Make adaptive execution treat tiny partitions as it would treat huge ones."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k in settings:
        spark.conf.unset(k)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def hot_events(spark, n):
    """A third of the events name one ticker on one day."""
    hot = F.col("id") % 3 == 0
    days = F.array(*[F.lit(d) for d in DAYS])
    return spark.range(n).repartition(8).select(
        F.concat(F.lit("A-"), F.col("id")).alias("accession"),
        F.lit(1).cast("long").alias("txn_sk"),
        F.when(hot, "HOT").otherwise(F.concat(F.lit("T"), F.col("id") % 17)).alias("ticker"),
        F.when(hot, F.lit(DAYS[0])).otherwise(F.get(days, (F.col("id") % 50).cast("int"))).alias("filing_date"),
    )


def test_panel_splits_a_hot_ticker_day(eager_splits):
    spark = eager_splits
    ev = hot_events(spark, 6_000)
    prices = spark.createDataFrame(
        [(t, d, 10.0 + i + len(t)) for t in ["HOT", *[f"T{k}" for k in range(17)]] for i, d in enumerate(DAYS)],
        "ticker string, date date, close double",
    )
    market = spark.createDataFrame([(d, 100.0) for d in DAYS], "date date, close double")
    panel = abnormal_returns(ev, prices, market, horizons={"1w": 5})
    assert "skew=true" in final_plan(panel)
    assert panel.count() == 6_000
    hot = panel.filter("ticker = 'HOT'").agg(F.count("ret_1w"), F.min("ret_1w"), F.max("ret_1w")).first()
    assert hot[0] == 2_000 and hot[1] == hot[2] == pytest.approx(18.0 / 13.0 - 1)


def raw_with_hot_filing(spark, n):
    """One filing holds a third of all owners and a third of all transactions."""
    accession = F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("A-"), F.col("id") % 400))
    base = spark.range(n).repartition(8).withColumn("ACCESSION_NUMBER", accession)
    sub = base.select("ACCESSION_NUMBER").distinct().select(
        "ACCESSION_NUMBER", F.lit("06-FEB-2024").alias("FILING_DATE"), F.lit("02-FEB-2024").alias("PERIOD_OF_REPORT"),
        F.lit("4").alias("DOCUMENT_TYPE"), F.lit("0077").alias("ISSUERCIK"), F.lit("Gadget").alias("ISSUERNAME"),
        F.lit("GDG").alias("ISSUERTRADINGSYMBOL"), F.lit("0").alias("AFF10B5ONE"),
    )
    own = base.select(
        "ACCESSION_NUMBER", F.col("id").cast("string").alias("RPTOWNERCIK"), F.lit("n").alias("RPTOWNERNAME"),
        F.when(F.col("id") % 2 == 0, "Director").otherwise("Officer").alias("RPTOWNER_RELATIONSHIP"),
        F.lit(None).cast("string").alias("RPTOWNER_TITLE"),
    )
    trn = base.select(
        "ACCESSION_NUMBER", F.col("id").alias("NONDERIV_TRANS_SK"), F.lit("02-FEB-2024").alias("TRANS_DATE"),
        F.lit("P").alias("TRANS_CODE"), F.lit(1.0).alias("TRANS_SHARES"), F.lit(2.0).alias("TRANS_PRICEPERSHARE"),
        F.lit(None).cast("string").alias("TRANS_PRICEPERSHARE_FN"), F.lit("A").alias("TRANS_ACQUIRED_DISP_CD"),
        F.lit(1.0).alias("SHRS_OWND_FOLWNG_TRANS"), F.lit("D").alias("DIRECT_INDIRECT_OWNERSHIP"),
    )
    return sub, own, trn


def test_event_build_splits_a_hot_filing_and_never_builds_its_product(eager_splits):
    sub, own, trn = raw_with_hot_filing(eager_splits, 9_000)
    out = events.purchase_events(sub, own, trn)
    assert "skew=true" in final_plan(out)
    hot = out.filter("accession = 'HOT'").agg(
        F.count(F.lit(1)), F.min("n_reporting_owners"), F.max("n_reporting_owners"), F.min("insider_id")
    ).first()
    assert tuple(hot) == (3_000, 3_000, 3_000, "0")


def test_hot_filing_gives_the_same_events_by_either_route(eager_splits):
    sub, own, trn = raw_with_hot_filing(eager_splits, 300)
    direct = events.purchase_events(sub, own, trn)
    flattened = collapse.collapse_cofilers(flatten.typed_rows(flatten.flatten_purchases(sub, own, trn)))
    assert rows(direct, "accession", "txn_sk") == rows(flattened, "accession", "txn_sk")


def test_hot_issuer_cluster_never_orders_raw_events(spark):
    """Windows see distinct insider-days; the hot issuer's events are only joined."""
    ev = hot_events(spark, 3_000).select(
        "accession", "txn_sk", F.col("ticker").alias("issuer_cik"),
        (F.abs(F.hash("accession")) % 40).cast("string").alias("insider_id"), "filing_date",
    )
    reduced = segments.cluster_counts(ev).groupBy("issuer_cik").count().agg(F.max("count")).first()[0]
    assert reduced <= 2 * len(DAYS)
    sized = segments.with_cluster_size(ev)
    assert sized.count() == 3_000
    hot = ev.filter("issuer_cik = 'HOT'").select("insider_id").distinct().count()
    assert sized.filter("issuer_cik = 'HOT'").agg(F.max("cluster_size")).first()[0] == hot


def test_flatten_splits_a_hot_filing(eager_splits):
    out = flatten.flatten_purchases(*raw_with_hot_filing(eager_splits, 900))
    assert "skew=true" in final_plan(out)
    assert out.filter("accession = 'HOT'").count() == 300 * 300


def test_footnote_flags_split_a_hot_filing(eager_splits):
    spark = eager_splits
    flat = flatten.typed_rows(flatten.flatten_purchases(*raw_with_hot_filing(spark, 900)))
    notes = spark.createDataFrame([("HOT", "Rule 10b5-1")], "ACCESSION_NUMBER string, FOOTNOTE_TXT string")
    out = collapse.with_footnote_plans(flat, notes)
    assert "skew=true" in final_plan(out)
    assert out.filter("is_10b5_1").count() == 300 * 300


def test_a_busy_insider_is_split_by_value(eager_splits):
    """The insider behind a third of the trades is halved again and again, never gathered."""
    spark = eager_splits
    ev = spark.range(6_000).repartition(8).select(
        F.concat(F.lit("A-"), F.col("id")).alias("accession"),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("i"), F.col("id") % 900)).alias("insider_id"),
        F.date_add(F.lit(DAYS[0]), (F.col("id") % 60).cast("int")).alias("filing_date"),
        F.pmod(F.hash("id"), F.lit(1_000)).cast("double").alias("value"),
    )
    got = medians.prior_medians(ev, window_rows=100, bucket_rows=50)
    hot = {r.filing_date: r.prior_median for r in got.filter("insider_id = 'HOT'").collect()}
    seen = sorted((r.filing_date, r.value) for r in ev.filter("insider_id = 'HOT'").collect())
    for day, median in hot.items():
        before = [v for d, v in seen if d < day]
        assert median == (statistics.median(before) if before else None)
    assert len(hot) == len({d for d, _ in seen})
