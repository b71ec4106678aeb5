"""Table shapes and the fixed vocabulary of the filing-event domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Holding horizons, in trading sessions.
HORIZONS: dict[str, int] = {"1d": 1, "1w": 5, "1m": 21, "3m": 63, "6m": 126, "12m": 252}

# What makes a row an open-market purchase, and what marks a planned trade.
PURCHASE_CODE = "P"
SALE_CODE = "S"
ACQUIRED = "A"
TRUE_WORDS = ("1", "true", "t", "yes", "y")
PLAN_PATTERN = "(?i)10b5-1"
DATE_FORMAT = "d-MMM-yyyy"
TICKER_PATTERN = "^[A-Za-z.]+$"
PRICE_CEILING = 10_000

# Raw quarterly tables: every field is text when it lands, and typed downstream.
RAW_COLUMNS: dict[str, tuple[str, ...]] = {
    "SUBMISSION": (
        "ACCESSION_NUMBER", "FILING_DATE", "PERIOD_OF_REPORT", "DOCUMENT_TYPE", "ISSUERCIK",
        "ISSUERNAME", "ISSUERTRADINGSYMBOL", "AFF10B5ONE",
    ),
    "REPORTINGOWNER": (
        "ACCESSION_NUMBER", "RPTOWNERCIK", "RPTOWNERNAME", "RPTOWNER_RELATIONSHIP",
        "RPTOWNER_TITLE",
    ),
    "NONDERIV_TRANS": (
        "ACCESSION_NUMBER", "NONDERIV_TRANS_SK", "TRANS_DATE", "TRANS_CODE", "TRANS_SHARES",
        "TRANS_PRICEPERSHARE", "TRANS_PRICEPERSHARE_FN", "TRANS_ACQUIRED_DISP_CD",
        "SHRS_OWND_FOLWNG_TRANS", "DIRECT_INDIRECT_OWNERSHIP",
    ),
    "FOOTNOTES": ("ACCESSION_NUMBER", "FOOTNOTE_TXT"),
}

# The canonical event table, one row per economic transaction.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("accession", T.StringType()),
        T.StructField("txn_sk", T.LongType()),
        T.StructField("issuer_cik", T.StringType()),
        T.StructField("issuer_name", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("filing_date", T.DateType()),
        T.StructField("txn_date", T.DateType()),
        T.StructField("period_of_report", T.DateType()),
        T.StructField("txn_code", T.StringType()),
        T.StructField("shares", T.DoubleType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("price_footnoted", T.BooleanType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("shares_owned_following", T.DoubleType()),
        T.StructField("direct_indirect", T.StringType()),
        T.StructField("is_10b5_1", T.BooleanType()),
        T.StructField("insider_id", T.StringType()),
        T.StructField("insider_name", T.StringType()),
        T.StructField("relationship", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("is_director", T.BooleanType()),
        T.StructField("is_officer", T.BooleanType()),
        T.StructField("is_ten_percent_owner", T.BooleanType()),
        T.StructField("is_other", T.BooleanType()),
        T.StructField("n_reporting_owners", T.LongType()),
    ]
)

EVENT_COLUMNS = tuple(EVENT_SCHEMA.fieldNames())
EVENT_KEY = ("accession", "txn_sk")
ROLE_FLAGS = ("is_director", "is_officer", "is_ten_percent_owner", "is_other")

DELISTING_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("delist_date", T.DateType()),
        T.StructField("recovery_value", T.DoubleType()),
    ]
)
