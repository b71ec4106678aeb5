from __future__ import annotations

import datetime as dt
import random

from conftest import rows
from pyspark.sql import functions as F

from tidemark.catalog.registry import flat_rows
from tidemark.fixtures import Tables
from tidemark.operators import collapse, flatten, quality
from tidemark.plans import events, reports
from tidemark.schemas import EVENT_SCHEMA

SF = "/root/testdata/sf0.001"


def test_normalize_types_and_derives(flat):
    [e] = rows(events.normalize(flat({"price_fn": "F2"})), "txn_sk")
    assert e["filing_date"] == dt.date(2024, 2, 6)
    assert e["txn_date"] == e["period_of_report"] == dt.date(2024, 2, 2)
    assert e["value"] == 100.0
    assert e["price_footnoted"] is True


def test_events_follow_the_contract_schema(flat):
    out = events.normalize(flat({}))
    assert [(f.name, f.dataType) for f in out.schema] == [
        (f.name, f.dataType) for f in EVENT_SCHEMA
    ]
    assert quality.schema_mismatches(out) == []
    assert quality.schema_mismatches(out.drop("ticker")) == ["ticker"]


def test_cofilers_become_one_event_with_all_roles(flat):
    out = events.normalize(
        flat(
            {"insider_id": "9", "relationship": "TenPercentOwner", "title": "CFO"},
            {"insider_id": "10", "relationship": "Officer", "title": None},
        )
    )
    [e] = rows(out, "txn_sk")
    assert e["n_reporting_owners"] == 2
    assert (e["is_officer"], e["is_ten_percent_owner"], e["is_director"]) == (True, True, False)
    assert e["shares"] == 40.0
    # Ids order as text, and the title is the first that is not null.
    assert (e["insider_id"], e["relationship"], e["title"]) == ("10", "Officer", "CFO")


def test_missing_owner_ids_come_first(flat):
    out = events.normalize(flat({"insider_id": "1"}, {"insider_id": None, "insider_name": "?"}))
    [e] = rows(out, "txn_sk")
    assert e["insider_id"] is None and e["insider_name"] == "?"


def test_transactions_of_one_filing_stay_apart(flat):
    out = events.normalize(flat({"txn_sk": 1}, {"txn_sk": 2, "price": 3.0}))
    assert [e["price"] for e in rows(out, "txn_sk")] == [2.5, 3.0]


def test_tied_owners_do_not_depend_on_row_order(flat):
    tied = [
        {"insider_id": "5", "insider_name": n, "relationship": r, "title": t}
        for n, r, t in [("B", "Officer", "VP"), ("A", "Other", None), ("A", "Director", "CEO")]
    ]
    want = rows(events.normalize(flat(*tied)), "txn_sk")
    for seed in range(3):
        random.Random(seed).shuffle(tied)
        assert rows(events.normalize(flat(*tied).repartition(3)), "txn_sk") == want
    assert (want[0]["insider_name"], want[0]["relationship"], want[0]["title"]) == ("A", "Director", "CEO")


def test_footnotes_flag_their_filing_only(spark, flat):
    notes = spark.createDataFrame(
        [("A-1", "bought under a"), ("A-1", "rule 10b5-1 plan"), ("A-2", None), ("A-3", "10b5 - 1")],
        "ACCESSION_NUMBER string, FOOTNOTE_TXT string",
    )
    out = events.normalize(
        flat(*[{"accession": f"A-{i}"} for i in range(1, 5)], {"accession": "A-5", "aff10b5one": "1"}),
        notes,
    )
    assert [e["is_10b5_1"] for e in rows(out, "accession")] == [True, False, False, False, True]
    mentions = {r.accession: r.planned_note for r in collapse.plan_mentions(notes).collect()}
    assert mentions == {"A-1": True, "A-2": False, "A-3": False}


def raw_tables(spark, filings, owners, trades):
    sub = spark.createDataFrame(
        [(a, "06-FEB-2024", "02-FEB-2024", d, "0077", "Gadget", "GDG", f) for a, d, f in filings],
        "ACCESSION_NUMBER string, FILING_DATE string, PERIOD_OF_REPORT string, DOCUMENT_TYPE string, "
        "ISSUERCIK string, ISSUERNAME string, ISSUERTRADINGSYMBOL string, AFF10B5ONE string",
    )
    own = spark.createDataFrame(
        owners,
        "ACCESSION_NUMBER string, RPTOWNERCIK string, RPTOWNERNAME string, RPTOWNER_RELATIONSHIP string, "
        "RPTOWNER_TITLE string",
    )
    trn = spark.createDataFrame(
        [(a, sk, "02-FEB-2024", c, s, p, None, ad, "10", "D") for a, sk, c, ad, s, p in trades],
        "ACCESSION_NUMBER string, NONDERIV_TRANS_SK string, TRANS_DATE string, TRANS_CODE string, "
        "TRANS_SHARES string, TRANS_PRICEPERSHARE string, TRANS_PRICEPERSHARE_FN string, "
        "TRANS_ACQUIRED_DISP_CD string, SHRS_OWND_FOLWNG_TRANS string, DIRECT_INDIRECT_OWNERSHIP string",
    )
    return sub, own, trn


def test_collapse_before_join_equals_join_before_collapse(spark):
    """Also where a filing was loaded twice and owners or transactions repeat."""
    sub, own, trn = raw_tables(
        spark,
        [("A", "4", "0"), ("A", "4", "1"), ("B", "4", None), ("C", "4/A", None)],
        [("A", "12", "x", "Officer", None), ("A", "7", "y", "Director", "CEO"), ("A", "7", "y", "Other", None),
         ("B", None, None, None, None), ("C", "1", "z", "Officer", "VP")],
        [("A", "1", "P", "A", "5", "2"), ("A", "1", "P", "A", "4", "2"), ("A", "2", "P", "A", "1", "x"),
         ("B", "1", "P", "A", "1", "1"), ("B", "2", "S", "D", "1", "1"), ("C", "1", "P", "A", "1", "1")],
    )
    for types in (("4",), ("4", "4/A")):
        direct = events.purchase_events(sub, own, trn, document_types=types)
        flattened = events.normalize(flatten.flatten_purchases(sub, own, trn, types))
        assert rows(direct, "accession", "txn_sk") == rows(flattened, "accession", "txn_sk")
    [a1, a2, b1] = rows(events.purchase_events(sub, own, trn), "accession", "txn_sk")
    assert (a1["n_reporting_owners"], a2["n_reporting_owners"], b1["n_reporting_owners"]) == (12, 6, 1)
    assert a2["price"] is None and a2["value"] is None


def test_events_on_test_tables_agree_and_count_every_flat_row(spark):
    t = Tables(spark, SF)
    flat = flat_rows(t)
    direct = events.purchase_events(t.submissions(), t.owners(), t.transactions(), t.footnotes())
    via_flat = events.normalize(flat, t.footnotes())
    assert rows(direct, "accession", "txn_sk") == rows(via_flat, "accession", "txn_sk")
    assert direct.agg(F.sum("n_reporting_owners")).first()[0] == flat.count()


def test_planned_trades_leave_the_built_events(spark, tmp_path):
    sub, own, trn = raw_tables(
        spark, [("A", "4", "true"), ("B", "4", "0")],
        [("A", "1", "x", "Officer", None), ("B", "1", "x", "Officer", None)],
        [("A", "1", "P", "A", "5", "2"), ("B", "1", "P", "A", "5", "2")],
    )
    out = events.build_events(sub, own, trn, out_path=str(tmp_path / "events"))
    assert [r.accession for r in out.collect()] == ["B"]
    assert (tmp_path / "events" / "filing_year=2024").is_dir()


def test_sanity_report_counts_null_as_a_value(spark, flat):
    typed = events.normalize(
        flat({"issuer_cik": None}, {"accession": "A-2", "price": 0.0}, {"accession": "A-3", "filing_date_raw": "x"})
    )
    trn = spark.createDataFrame(
        [("P", "A"), ("P", "D"), ("S", "D"), ("S", "D"), ("S", "A")],
        "TRANS_CODE string, TRANS_ACQUIRED_DISP_CD string",
    )
    got = {r.metric: r.value for r in reports.sanity_report(typed, trn).collect()}
    assert got["n_events"] == "3" and got["distinct_issuers"] == "2" and got["distinct_insiders"] == "1"
    assert (got["raw_purchases"], got["raw_sales"], got["buy_sell_ratio"]) == ("2", "3", "0.667")
    assert got["null_or_zero_price"] == "1" and got["by_year.2024"] == "2"
    no_sales = {r.metric: r.value for r in reports.sanity_report(typed, trn.filter("TRANS_CODE = 'P'")).collect()}
    assert no_sales["buy_sell_ratio"] is None


def test_reports_on_no_events(flat, spark):
    none = events.normalize(flat({})).filter("false")
    trn = spark.createDataFrame([], "TRANS_CODE string, TRANS_ACQUIRED_DISP_CD string")
    got = {r.metric: r.value for r in reports.sanity_report(none, trn).collect()}
    assert got["n_events"] == got["distinct_issuers"] == "0" and got["filing_date_min"] is None


def test_largest_purchases_skip_unreliable_prices(flat):
    typed = events.normalize(
        flat(
            {"accession": "A", "price": 9.0}, {"accession": "B", "price": 5.0},
            {"accession": "C", "price": 99.0, "price_fn": "F1"}, {"accession": "D", "price": 20_000.0},
            {"accession": "E", "shares": None},
        )
    )
    assert [r.accession for r in reports.largest_purchases(typed, 3).collect()] == ["A", "B", "E"]


def test_contract_counts_breaks_and_repeats(spark, flat):
    typed = events.normalize(flat({"insider_id": None}, {"accession": "B", "price": -1.0}))
    got = {r.rule: r.violations for r in quality.event_contract(typed.union(typed)).collect()}
    assert got["insider_id is missing"] == 2 and got["price is negative"] == 2
    assert got["event key repeats"] == 2 and got["txn_code is not P"] == 0


def test_a_quarter_loaded_twice_shows_in_the_raw_keys(spark):
    sub, own, trn = raw_tables(
        spark, [("A", "4", None)], [("A", "1", "x", None, None)], [("A", "1", "P", "A", "1", "1")]
    )
    twice = quality.raw_key_contract(sub.union(sub), own.union(own), trn)
    assert {r.rule: r.violations for r in twice.collect()} == {
        "submission key repeats": 1, "owner key repeats": 1, "transaction key repeats": 0,
    }
