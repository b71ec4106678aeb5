"""Row-level rules that define the signal: which filing rows count as a purchase."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import (
    ACQUIRED,
    DATE_FORMAT,
    PLAN_PATTERN,
    PRICE_CEILING,
    PURCHASE_CODE,
    TICKER_PATTERN,
    TRUE_WORDS,
)

# The public filing index address.
FILING_INDEX_ROOT = "https://www.sec.gov/Archives/edgar/data/"

# The text each role flag looks for in the comma-joined relationship.
ROLE_WORDS = {
    "is_director": "director",
    "is_officer": "officer",
    "is_ten_percent_owner": "tenpercent",
    "is_other": "other",
}


def is_purchase(code: str = "TRANS_CODE", disposition: str = "TRANS_ACQUIRED_DISP_CD") -> Column:
    return (F.col(code) == PURCHASE_CODE) & (F.col(disposition) == ACQUIRED)


def open_market_purchases(
    df: DataFrame, code: str = "TRANS_CODE", disposition: str = "TRANS_ACQUIRED_DISP_CD"
) -> DataFrame:
    """Rows that are both a purchase and an acquisition; nulls drop."""
    return df.filter(is_purchase(code, disposition))


def of_document_types(
    df: DataFrame, types: Iterable[str] = ("4",), column: str = "document_type"
) -> DataFrame:
    return df.filter(F.col(column).isin(*types))


def messy_flag(raw: Column) -> Column:
    """A free-text yes/no field as a boolean; anything unknown is false."""
    text = F.lower(F.regexp_replace(raw.cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.coalesce(text.isin(*TRUE_WORDS), F.lit(False))


def with_planned_flag(df: DataFrame, column: str = "aff10b5one", out: str = "is_10b5_1") -> DataFrame:
    """Add the planned-trade flag; a table without the source column is all false."""
    return df.withColumn(out, messy_flag(F.col(column)) if column in df.columns else F.lit(False))


def role_flag(relationship: Column, word: str) -> Column:
    return F.contains(F.lower(F.coalesce(relationship.cast("string"), F.lit(""))), F.lit(word))


def with_role_flags(df: DataFrame, column: str = "relationship") -> DataFrame:
    return df.withColumns({flag: role_flag(F.col(column), word) for flag, word in ROLE_WORDS.items()})


def mentions_plan(text: Column) -> Column:
    return F.coalesce(text.cast("string").rlike(PLAN_PATTERN), F.lit(False))


def drop_planned(
    df: DataFrame, flag: str = "is_10b5_1", footnote: str | None = None
) -> DataFrame:
    """Remove scheduled trades by flag and, if named, by footnote text; nulls are kept."""
    if flag in df.columns:
        df = df.filter(~F.coalesce(F.col(flag), F.lit(False)))
    if footnote is not None and footnote in df.columns:
        df = df.filter(~mentions_plan(F.col(footnote)))
    return df


def filing_day(raw: Column) -> Column:
    """``31-MAR-2025`` as a date; text that is not a date becomes null."""
    return F.try_to_date(raw.cast("string"), DATE_FORMAT)


def trade_value(shares: Column, price: Column) -> Column:
    return shares * price


def is_footnoted(price_note: Column) -> Column:
    return price_note.isNotNull()


def has_study_ticker(ticker: Column) -> Column:
    """Tickers the study accepts: letters and dots only."""
    return ticker.isNotNull() & (F.length(ticker) > 0) & ticker.rlike(TICKER_PATTERN)


def eligible_events(df: DataFrame) -> DataFrame:
    return df.filter(has_study_ticker(F.col("ticker")))


def requestable_tickers(df: DataFrame, column: str = "ticker") -> DataFrame:
    """Distinct tickers a price table can be asked for: ASCII, alphanumeric besides dots."""
    return (
        df.filter(F.col(column).rlike("^[A-Za-z0-9.]*[A-Za-z0-9][A-Za-z0-9.]*$"))
        .select(column)
        .distinct()
    )


def has_reliable_price(footnoted: str = "price_footnoted", price: str = "price") -> Column:
    return ~F.col(footnoted) & (F.col(price) > 0) & (F.col(price) < PRICE_CEILING)


def padded_cik(cik: Column) -> Column:
    """The CIK padded for lookups; what is no number has no padded form."""
    number = cik.cast("string").try_cast("long")
    return F.when(number.isNotNull(), F.format_string("CIK%010d", number))


def plain_cik(cik: Column) -> Column:
    """A CIK as unpadded text, the form in which filers are ordered."""
    text = cik.cast("string")
    return F.coalesce(text.try_cast("long").cast("string"), text)


def filing_url(accession: Column, cik: Column) -> Column:
    """Address of the filing's public index page."""
    return F.concat(
        F.lit(FILING_INDEX_ROOT),
        plain_cik(cik),
        F.lit("/"),
        F.replace(accession, F.lit("-"), F.lit("")),
        F.lit("/"),
        accession,
        F.lit("-index.htm"),
    )
