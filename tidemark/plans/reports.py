"""Sanity reports over the event table and the raw transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import signals
from tidemark.schemas import EVENT_KEY, PRICE_CEILING, PURCHASE_CODE, SALE_CODE


def code_distribution(transactions: DataFrame) -> DataFrame:
    """Rows per transaction code and disposition, most frequent first."""
    return (
        transactions.groupBy("TRANS_CODE", F.col("TRANS_ACQUIRED_DISP_CD").alias("ad"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "TRANS_CODE", "ad")
    )


def events_by_year(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("filing_date").isNotNull())
        .groupBy(F.year("filing_date").cast("long").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("year")
    )


def _distinct_with_null(column: str):
    """Distinct values, where null counts as one."""
    has_null = F.max(F.col(column).isNull().cast("long"))
    return F.count_distinct(F.col(column)) + F.coalesce(has_null, F.lit(0))


def sanity_report(events: DataFrame, transactions: DataFrame) -> DataFrame:
    """(metric, value) rows: the counts to look at before trusting an ingest.

    Two small aggregates, one over the events and one over the raw transactions, are laid out
    as text rows; the by-year counts follow as ``by_year.<year>``. Events are read twice, so hand
    over a stored table.
    """
    price = F.col("price")
    counts = {
        "n_events": F.count(F.lit(1)),
        "distinct_issuers": _distinct_with_null("issuer_cik"),
        "distinct_insiders": _distinct_with_null("insider_id"),
        "filing_date_min": F.min("filing_date"),
        "filing_date_max": F.max("filing_date"),
        "null_or_zero_price": F.count_if(price.isNull() | (price == 0)),
        "footnoted_price": F.count_if("price_footnoted"),
        "suspect_price_gt_10k": F.count_if(price > PRICE_CEILING),
        "multi_owner_filings": F.count_if(F.col("n_reporting_owners") > 1),
        "role_counts.director": F.count_if("is_director"),
        "role_counts.officer": F.count_if("is_officer"),
        "role_counts.ten_percent": F.count_if("is_ten_percent_owner"),
        "role_counts.other": F.count_if("is_other"),
    }
    raw = {
        "raw_purchases": F.count_if(F.col("TRANS_CODE") == PURCHASE_CODE),
        "raw_sales": F.count_if(F.col("TRANS_CODE") == SALE_CODE),
    }

    def rows(df: DataFrame, metrics: dict) -> DataFrame:
        named = df.agg(*[e.alias(n) for n, e in metrics.items()])
        pairs = [
            F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("string").alias("value"))
            for n in metrics
        ]
        return named.select(F.inline(F.array(*pairs)))

    sides = transactions.agg(*[e.alias(n) for n, e in raw.items()])
    ratio = F.try_divide(F.col("raw_purchases"), F.col("raw_sales"))
    raw_rows = sides.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("metric"), F.col(n).cast("string").alias("value"))
                    for n in raw
                ],
                F.struct(
                    F.lit("buy_sell_ratio").alias("metric"),
                    F.bround(ratio, 3).cast("decimal(20,3)").cast("string").alias("value"),
                ),
            )
        )
    )
    years = events_by_year(events).select(
        F.concat(F.lit("by_year."), F.col("year").cast("string")).alias("metric"),
        F.col("n").cast("string").alias("value"),
    )
    return rows(events, counts).unionByName(raw_rows).unionByName(years)


def largest_purchases(events: DataFrame, k: int = 8) -> DataFrame:
    """The k largest reliably priced purchases with the address to check each one by hand."""
    return (
        events.filter(signals.has_reliable_price())
        .orderBy(F.desc_nulls_last("value"), *EVENT_KEY)
        .limit(k)
        .select(
            *EVENT_KEY,
            "ticker",
            "filing_date",
            "insider_name",
            "shares",
            "price",
            "value",
            signals.filing_url(F.col("accession"), F.col("issuer_cik")).alias("url"),
        )
    )
