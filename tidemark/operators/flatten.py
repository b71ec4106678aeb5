"""Typed views of the raw tables, and their three-way flatten."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import signals
from tidemark.operators.joins import splittable_join

FLAT_COLUMNS = (
    "accession", "filing_date_raw", "period_raw", "document_type", "issuer_cik", "issuer_name",
    "ticker", "aff10b5one", "insider_id", "insider_name", "relationship", "title", "txn_sk",
    "txn_date_raw", "txn_code", "shares", "price", "price_fn", "ad", "shares_owned_following",
    "direct_indirect",
)


def filing_columns(submissions: DataFrame, *carry: str) -> DataFrame:
    return submissions.select(
        *carry,
        F.col("ACCESSION_NUMBER").alias("accession"),
        F.col("FILING_DATE").alias("filing_date_raw"),
        F.col("PERIOD_OF_REPORT").alias("period_raw"),
        F.col("DOCUMENT_TYPE").alias("document_type"),
        signals.plain_cik(F.col("ISSUERCIK")).alias("issuer_cik"),
        F.col("ISSUERNAME").alias("issuer_name"),
        F.col("ISSUERTRADINGSYMBOL").alias("ticker"),
        F.col("AFF10B5ONE").alias("aff10b5one"),
    )


def owner_columns(owners: DataFrame, *carry: str) -> DataFrame:
    return owners.select(
        *carry,
        F.col("ACCESSION_NUMBER").alias("accession"),
        signals.plain_cik(F.col("RPTOWNERCIK")).alias("insider_id"),
        F.col("RPTOWNERNAME").alias("insider_name"),
        F.col("RPTOWNER_RELATIONSHIP").alias("relationship"),
        F.col("RPTOWNER_TITLE").alias("title"),
    )


def trade_columns(transactions: DataFrame, *carry: str) -> DataFrame:
    return transactions.select(
        *carry,
        F.col("ACCESSION_NUMBER").alias("accession"),
        F.col("NONDERIV_TRANS_SK").try_cast("long").alias("txn_sk"),
        F.col("TRANS_DATE").alias("txn_date_raw"),
        F.col("TRANS_CODE").alias("txn_code"),
        F.col("TRANS_SHARES").try_cast("double").alias("shares"),
        F.col("TRANS_PRICEPERSHARE").try_cast("double").alias("price"),
        F.col("TRANS_PRICEPERSHARE_FN").alias("price_fn"),
        F.col("TRANS_ACQUIRED_DISP_CD").alias("ad"),
        F.col("SHRS_OWND_FOLWNG_TRANS").try_cast("double").alias("shares_owned_following"),
        F.col("DIRECT_INDIRECT_OWNERSHIP").alias("direct_indirect"),
    )


def purchase_filings(submissions: DataFrame, document_types: Iterable[str], *carry: str) -> DataFrame:
    return signals.of_document_types(filing_columns(submissions, *carry), document_types)


def purchase_trades(transactions: DataFrame, *carry: str) -> DataFrame:
    return trade_columns(signals.open_market_purchases(transactions), *carry)


def flatten_purchases(
    submissions: DataFrame,
    owners: DataFrame,
    transactions: DataFrame,
    document_types: Iterable[str] = ("4",),
) -> DataFrame:
    """One row per purchase and reporting owner, 21 text-dated columns.

    Both filters run before the joins. The result holds every owner beside every transaction of
    a filing, so both joins are planned to be split where one filing is large.
    """
    trades = splittable_join(
        purchase_trades(transactions), purchase_filings(submissions, document_types), "accession"
    )
    return splittable_join(trades, owner_columns(owners), "accession").select(*FLAT_COLUMNS)


def typed_filings(filings: DataFrame) -> DataFrame:
    return signals.with_planned_flag(filings).withColumns(
        {
            "filing_date": signals.filing_day(F.col("filing_date_raw")),
            "period_of_report": signals.filing_day(F.col("period_raw")),
        }
    )


def typed_trades(trades: DataFrame) -> DataFrame:
    return trades.withColumns(
        {
            "txn_date": signals.filing_day(F.col("txn_date_raw")),
            "value": signals.trade_value(F.col("shares"), F.col("price")),
            "price_footnoted": signals.is_footnoted(F.col("price_fn")),
        }
    )


def typed_rows(flat: DataFrame) -> DataFrame:
    """Flags, dates and derived values on already flattened rows."""
    return signals.with_role_flags(typed_trades(typed_filings(flat)))
