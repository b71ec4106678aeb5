"""Signal rules, joins and the collapse into events, and the reports over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.registry import (
    all_events,
    flat_rows,
    query,
    study_events,
    unplanned_events,
)
from tidemark.fixtures import Tables
from tidemark.functions import signals
from tidemark.operators import collapse, flatten, quality, sample
from tidemark.plans import events as event_plans
from tidemark.plans import reports
from tidemark.plans.panel import abnormal_returns
from tidemark.session import materialize


@query(
    "f1_purchases",
    "SELECT ACCESSION_NUMBER, NONDERIV_TRANS_SK, TRANS_CODE, TRANS_ACQUIRED_DISP_CD FROM trn "
    "WHERE TRANS_CODE = 'P' AND TRANS_ACQUIRED_DISP_CD = 'A'",
)
def f1_purchases(t: Tables) -> DataFrame:
    return signals.open_market_purchases(t.transactions()).select(
        "ACCESSION_NUMBER", "NONDERIV_TRANS_SK", "TRANS_CODE", "TRANS_ACQUIRED_DISP_CD"
    )


@query(
    "f2_doctype",
    "SELECT ACCESSION_NUMBER, DOCUMENT_TYPE FROM sub WHERE DOCUMENT_TYPE IN ('4', '4/A')",
)
def f2_doctype(t: Tables) -> DataFrame:
    return signals.of_document_types(t.submissions(), ("4", "4/A"), "DOCUMENT_TYPE").select(
        "ACCESSION_NUMBER", "DOCUMENT_TYPE"
    )


@query(
    "f3_flag",
    "SELECT ACCESSION_NUMBER, AFF10B5ONE, "
    "coalesce(lower(trim(AFF10B5ONE)) IN ('1', 'true', 't', 'yes', 'y'), false) AS is_10b5_1 FROM sub",
)
def f3_flag(t: Tables) -> DataFrame:
    return signals.with_planned_flag(t.submissions(), "AFF10B5ONE").select(
        "ACCESSION_NUMBER", "AFF10B5ONE", "is_10b5_1"
    )


@query(
    "f4_roles",
    "SELECT ACCESSION_NUMBER, RPTOWNERCIK, "
    + ", ".join(
        f"contains(lower(coalesce(RPTOWNER_RELATIONSHIP, '')), '{w}') AS {f}"
        for f, w in signals.ROLE_WORDS.items()
    )
    + " FROM own",
)
def f4_roles(t: Tables) -> DataFrame:
    return signals.with_role_flags(t.owners(), "RPTOWNER_RELATIONSHIP").select(
        "ACCESSION_NUMBER", "RPTOWNERCIK", *signals.ROLE_WORDS
    )


@query(
    "f5_unplanned",
    "SELECT n.ACCESSION_NUMBER AS accession, md5(FOOTNOTE_TXT) AS note FROM notes n JOIN sub s "
    "ON n.ACCESSION_NUMBER = s.ACCESSION_NUMBER "
    "WHERE NOT coalesce(lower(trim(AFF10B5ONE)) IN ('1', 'true', 't', 'yes', 'y'), false) "
    "AND NOT regexp_matches(coalesce(FOOTNOTE_TXT, ''), '(?i)10b5-1')",
)
def f5_unplanned(t: Tables) -> DataFrame:
    flags = signals.with_planned_flag(t.submissions(), "AFF10B5ONE").select(
        "ACCESSION_NUMBER", "is_10b5_1"
    )
    noted = t.footnotes().join(flags, "ACCESSION_NUMBER")
    return signals.drop_planned(noted, footnote="FOOTNOTE_TXT").select(
        F.col("ACCESSION_NUMBER").alias("accession"),
        F.md5(F.col("FOOTNOTE_TXT").cast("binary")).alias("note"),
    )


@query(
    "f6_dates",
    "SELECT ACCESSION_NUMBER AS accession, CAST(try_strptime(FILING_DATE, '%d-%b-%Y') AS DATE) AS filing_date, "
    "CAST(try_strptime(PERIOD_OF_REPORT, '%d-%b-%Y') AS DATE) AS period_of_report FROM sub",
)
def f6_dates(t: Tables) -> DataFrame:
    return t.submissions().select(
        F.col("ACCESSION_NUMBER").alias("accession"),
        signals.filing_day(F.col("FILING_DATE")).alias("filing_date"),
        signals.filing_day(F.col("PERIOD_OF_REPORT")).alias("period_of_report"),
    )


@query(
    "f7_value",
    "SELECT ACCESSION_NUMBER AS accession, NONDERIV_TRANS_SK AS txn_sk, "
    "TRANS_SHARES * TRANS_PRICEPERSHARE AS value, TRANS_PRICEPERSHARE_FN IS NOT NULL AS price_footnoted FROM trn",
)
def f7_value(t: Tables) -> DataFrame:
    return flatten.typed_trades(flatten.trade_columns(t.transactions())).select(
        "accession", "txn_sk", "value", "price_footnoted"
    )


@query(
    "f8_eligible",
    "SELECT ACCESSION_NUMBER AS accession, ISSUERTRADINGSYMBOL AS ticker FROM sub "
    "WHERE length(ISSUERTRADINGSYMBOL) > 0 AND regexp_matches(ISSUERTRADINGSYMBOL, '^[A-Za-z.]+$')",
)
def f8_eligible(t: Tables) -> DataFrame:
    return signals.eligible_events(flatten.filing_columns(t.submissions())).select(
        "accession", "ticker"
    )


@query(
    "f9_hygiene",
    "SELECT DISTINCT ISSUERTRADINGSYMBOL AS ticker FROM sub "
    "WHERE regexp_matches(replace(ISSUERTRADINGSYMBOL, '.', ''), '^[A-Za-z0-9]+$')",
)
def f9_hygiene(t: Tables) -> DataFrame:
    return signals.requestable_tickers(flatten.filing_columns(t.submissions()))


@query(
    "f10_reliable",
    "SELECT ACCESSION_NUMBER AS accession, NONDERIV_TRANS_SK AS txn_sk, TRANS_PRICEPERSHARE AS price FROM trn "
    "WHERE TRANS_PRICEPERSHARE_FN IS NULL AND TRANS_PRICEPERSHARE > 0 AND TRANS_PRICEPERSHARE < 10000",
)
def f10_reliable(t: Tables) -> DataFrame:
    trades = flatten.typed_trades(flatten.trade_columns(t.transactions()))
    return trades.filter(signals.has_reliable_price()).select("accession", "txn_sk", "price")


@query(
    "f11_sample",
    "SELECT accession, txn_sk, ticker, filing_date FROM elig "
    "ORDER BY md5(accession || '|' || txn_sk || '|1'), accession, txn_sk LIMIT 400",
)
def f11_sample(t: Tables) -> DataFrame:
    return sample.seeded_sample(study_events(t), 400, seed=1).select(
        "accession", "txn_sk", "ticker", "filing_date"
    )


@query(
    "f12_cik",
    "SELECT ACCESSION_NUMBER AS accession, 'CIK' || lpad(CAST(CAST(ISSUERCIK AS BIGINT) AS VARCHAR), 10, '0') AS cik FROM sub",
)
def f12_cik(t: Tables) -> DataFrame:
    return t.submissions().select(
        F.col("ACCESSION_NUMBER").alias("accession"),
        signals.padded_cik(F.col("ISSUERCIK")).alias("cik"),
    )


@query(
    "f13_url",
    "SELECT ACCESSION_NUMBER AS accession, 'https://www.sec.gov/Archives/edgar/data/' || CAST(ISSUERCIK AS BIGINT) "
    "|| '/' || replace(ACCESSION_NUMBER, '-', '') || '/' || ACCESSION_NUMBER || '-index.htm' AS url FROM sub",
)
def f13_url(t: Tables) -> DataFrame:
    return t.submissions().select(
        F.col("ACCESSION_NUMBER").alias("accession"),
        signals.filing_url(F.col("ACCESSION_NUMBER"), F.col("ISSUERCIK")).alias("url"),
    )


@query(
    "f14_flatten",
    "SELECT ACCESSION_NUMBER AS accession, FILING_DATE AS filing_date_raw, PERIOD_OF_REPORT AS period_raw, "
    "DOCUMENT_TYPE AS document_type, CAST(CAST(ISSUERCIK AS BIGINT) AS VARCHAR) AS issuer_cik, "
    "ISSUERNAME AS issuer_name, ISSUERTRADINGSYMBOL AS ticker, AFF10B5ONE AS aff10b5one FROM sub",
)
def f14_flatten(t: Tables) -> DataFrame:
    return flatten.filing_columns(t.submissions())


@query("j1_flatten_join", "SELECT * FROM flat")
def j1_flatten_join(t: Tables) -> DataFrame:
    return flat_rows(t)


@query(
    "j2_footnote_or",
    "SELECT s.ACCESSION_NUMBER AS accession, "
    "coalesce(lower(trim(AFF10B5ONE)) IN ('1', 'true', 't', 'yes', 'y'), false) OR coalesce(planned_note, false) "
    "AS is_10b5_1 FROM sub s LEFT JOIN note_hits h ON s.ACCESSION_NUMBER = h.accession",
)
def j2_footnote_or(t: Tables) -> DataFrame:
    filings = signals.with_planned_flag(flatten.filing_columns(t.submissions()))
    return collapse.with_footnote_plans(filings, t.footnotes()).select("accession", "is_10b5_1")


@query("a1_collapse", "SELECT * FROM all_events_noscan")
def a1_collapse(t: Tables) -> DataFrame:
    return collapse.collapse_cofilers(flatten.typed_rows(flat_rows(t)))


@query("a2_footnote_scan", "SELECT accession, planned_note FROM note_hits")
def a2_footnote_scan(t: Tables) -> DataFrame:
    return collapse.plan_mentions(t.footnotes())


@query(
    "a3_codes",
    "SELECT TRANS_CODE, TRANS_ACQUIRED_DISP_CD AS ad, count(*) AS n FROM trn GROUP BY 1, 2 ORDER BY n DESC",
)
def a3_codes(t: Tables) -> DataFrame:
    return reports.code_distribution(t.transactions())


_SANITY = {
    "n_events": "count(*)",
    "distinct_issuers": "count(DISTINCT issuer_cik) + max(CASE WHEN issuer_cik IS NULL THEN 1 ELSE 0 END)",
    "distinct_insiders": "count(DISTINCT insider_id) + max(CASE WHEN insider_id IS NULL THEN 1 ELSE 0 END)",
    "filing_date_min": "min(filing_date)",
    "filing_date_max": "max(filing_date)",
    "null_or_zero_price": "count(*) FILTER (WHERE price IS NULL OR price = 0)",
    "footnoted_price": "count(*) FILTER (WHERE price_footnoted)",
    "suspect_price_gt_10k": "count(*) FILTER (WHERE price > 10000)",
    "multi_owner_filings": "count(*) FILTER (WHERE n_reporting_owners > 1)",
    "role_counts.director": "count(*) FILTER (WHERE is_director)",
    "role_counts.officer": "count(*) FILTER (WHERE is_officer)",
    "role_counts.ten_percent": "count(*) FILTER (WHERE is_ten_percent_owner)",
    "role_counts.other": "count(*) FILTER (WHERE is_other)",
}


@query(
    "a4_sanity",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST({e} AS VARCHAR) AS value FROM ev" for m, e in _SANITY.items()
    )
    + " UNION ALL SELECT 'raw_purchases', CAST(count(*) AS VARCHAR) FROM trn WHERE TRANS_CODE = 'P'"
    " UNION ALL SELECT 'raw_sales', CAST(count(*) AS VARCHAR) FROM trn WHERE TRANS_CODE = 'S'"
    " UNION ALL SELECT 'buy_sell_ratio', CAST(CAST(round(count(*) FILTER (WHERE TRANS_CODE = 'P') / "
    "count(*) FILTER (WHERE TRANS_CODE = 'S'), 3) AS DECIMAL(20, 3)) AS VARCHAR) FROM trn"
    " UNION ALL SELECT 'by_year.' || year(filing_date), CAST(count(*) AS VARCHAR) FROM ev "
    "WHERE filing_date IS NOT NULL GROUP BY year(filing_date)",
)
def a4_sanity(t: Tables) -> DataFrame:
    return reports.sanity_report(materialize(unplanned_events(t)), t.transactions())


@query(
    "a5_by_year",
    "SELECT year(filing_date) AS year, count(*) AS n FROM ev WHERE filing_date IS NOT NULL GROUP BY 1",
)
def a5_by_year(t: Tables) -> DataFrame:
    return reports.events_by_year(unplanned_events(t))


@query("v5_events", "SELECT * FROM ev")
def v5_events(t: Tables) -> DataFrame:
    return event_plans.build_events(
        t.submissions(), t.owners(), t.transactions(), t.footnotes()
    )


@query(
    "v6_normalize",
    "SELECT * FROM all_events",
    flat="SELECT * FROM flat_all WHERE document_type IN ('4', '4/A')",
)
def v6_normalize(t: Tables) -> DataFrame:
    return event_plans.normalize(flat_rows(t, ("4", "4/A")), t.footnotes())


@query(
    "k1_topk",
    "SELECT accession, txn_sk, ticker, filing_date, insider_name, shares, price, value, "
    "'https://www.sec.gov/Archives/edgar/data/' || CAST(issuer_cik AS BIGINT) || '/' || replace(accession, '-', '') "
    "|| '/' || accession || '-index.htm' AS url FROM ev WHERE NOT price_footnoted AND price > 0 AND price < 10000 "
    "ORDER BY value DESC NULLS LAST, accession, txn_sk LIMIT 8",
)
def k1_topk(t: Tables) -> DataFrame:
    return reports.largest_purchases(unplanned_events(t), 8)


def _count_rule(rule: str, source: str, condition: str) -> str:
    return f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE {condition}) AS violations FROM {source}"


def _repeat_rule(rule: str, source: str, key: str) -> str:
    return (
        f"SELECT '{rule}', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {source})) AS BIGINT) "
        f"FROM {source}"
    )


@query(
    "q1_contract",
    " UNION ALL ".join(
        [_count_rule(f"{c} is missing", "all_events", f"{c} IS NULL") for c in quality.REQUIRED]
        + [
            _count_rule("txn_code is not P", "all_events", "txn_code IS DISTINCT FROM 'P'"),
            _count_rule("price is negative", "all_events", "price < 0"),
            _count_rule("n_reporting_owners below 1", "all_events", "n_reporting_owners < 1"),
            _repeat_rule("event key repeats", "all_events", "accession, txn_sk"),
            _count_rule("entry before filing", "wide", "entry_date < filing_date"),
            _count_rule("entry price not positive", "wide", "entry_close <= 0"),
            _repeat_rule("submission key repeats", "sub", "ACCESSION_NUMBER"),
            _repeat_rule("owner key repeats", "own", "ACCESSION_NUMBER, RPTOWNERCIK"),
            _repeat_rule("transaction key repeats", "trn", "ACCESSION_NUMBER, NONDERIV_TRANS_SK"),
            _repeat_rule("price key repeats", "px", "ticker, date"),
            _count_rule("close not positive", "px", "close <= 0"),
        ]
    ),
)
def q1_contract(t: Tables) -> DataFrame:
    events = materialize(all_events(t))
    chosen = signals.eligible_events(signals.drop_planned(events))
    panel = abnormal_returns(chosen, t.prices(), t.benchmark())
    return (
        quality.event_contract(events)
        .unionByName(quality.panel_contract(panel))
        .unionByName(quality.raw_key_contract(t.submissions(), t.owners(), t.transactions()))
        .unionByName(quality.price_contract(t.prices()))
    )
