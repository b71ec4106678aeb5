from __future__ import annotations

import datetime as dt
import json

from conftest import rows

from tidemark.sources import histories


def history(*filings):
    """Parallel arrays of (accession, day, form)."""
    return {"accessionNumber": [a for a, _, _ in filings], "filingDate": [d for _, d, _ in filings], "reportDate": ["" for _ in filings],
            "form": [f for _, _, f in filings], "isXBRL": [0 for _ in filings]}


def write(folder, files):
    for name, content in files.items():
        (folder / name).write_text(content if isinstance(content, str) else json.dumps(content, indent=1))
    return str(folder)


def test_histories_and_their_continuations(spark, tmp_path):
    path = write(tmp_path, {
        "CIK0000000077.json": {"cik": "0000000077", "name": "Gadget", "filings": {"recent": history(("A-3", "2024-03-01", "4"), ("A-2", "2024-02-01", "8-K")), "files": []}},
        "CIK0000000077-submissions-001.json": history(("A-1", "2003-05-06", "4")),
        "CIK0000000500.json": {"cik": 500, "filings": {"recent": history(("A-3", "2024-03-01", "4"), ("", "2024-01-01", "4"), ("A-9", "soon", "4"))}},
        "CIK0000000600.json": {"cik": "600", "filings": {"recent": {"accessionNumber": ["A-7"]}}},
        "CIK0000000700.json": {"cik": "700", "filings": {"recent": history()}},
        "broken.json": "{\"cik\": \"8",
        "nobody.json": history(("A-5", "2024-01-01", "4")),
    })
    got = rows(histories.read_filing_histories(spark, path).filter("cik IS NOT NULL").drop("document", "period_of_report"), "accession", "cik")
    day = dt.date
    assert [(r["cik"], r["accession"], r["form_type"], r["filing_date"]) for r in got] == [
        ("77", "A-1", "4", day(2003, 5, 6)), ("77", "A-2", "8-K", day(2024, 2, 1)), ("500", "A-3", "4", day(2024, 3, 1)),
        ("77", "A-3", "4", day(2024, 3, 1)), ("600", "A-7", None, None), ("500", "A-9", "4", None),
    ]
    assert [r["file"] for r in rows(histories.unreadable_histories(spark, path), "file")] == ["broken.json", "nobody.json"]


def test_a_filing_is_missing_once_however_many_list_it(spark):
    day = dt.date(2024, 1, 2)
    listed = [("77", "A-1", "4", day), ("500", "A-1", "4", day), ("500", "A-1", "4", None), ("77", "A-2", "4", day), ("77", "A-3", "8-K", day), ("9", "A-4", "4", None)]
    table = spark.createDataFrame([(*r, None) for r in listed], "cik string, accession string, form_type string, filing_date date, period_of_report date")
    held = spark.createDataFrame([("A-2",), (None,)], "ACCESSION_NUMBER string")
    got = [(r["accession"], r["filing_date"], r["filers"]) for r in rows(histories.unpublished(table, held), "accession")]
    assert got == [("A-1", day, 2), ("A-4", None, 1)]
    assert histories.unpublished(table.limit(0), held).count() == 0


def test_ticker_map_fills_what_the_study_would_not_accept(spark, tmp_path):
    path = write(tmp_path, {"company_tickers.json": {
        "0": {"cik_str": 77, "ticker": "GDGB", "title": "Gadget"}, "1": {"cik_str": 88, "ticker": "X-W", "title": "X"},
        "10": {"cik_str": 77, "ticker": "AAA", "title": "Gadget"}, "2": {"cik_str": 99, "ticker": "", "title": "none"}, "3": {"ticker": "LOST", "title": "no filer"},
    }})
    known = histories.read_ticker_map(spark, path)
    assert [(r["cik"], r["ticker"], r["place"]) for r in rows(known, "place")] == [("77", "GDGB", 0), ("88", "X-W", 1), ("77", "AAA", 10)]
    events = spark.createDataFrame(
        [(1, "77", None), (2, "77", ""), (3, "77", "N/A"), (4, "77", "OWN"), (5, "66", None), (6, None, "N/A"), (7, "88", None)], "k int, issuer_cik string, ticker string"
    )
    got = {r["k"]: (r["ticker"], r["ticker_filled"]) for r in rows(histories.fill_tickers(events, known), "k")}
    assert got == {1: ("GDGB", True), 2: ("GDGB", True), 3: ("GDGB", True), 4: ("OWN", False), 5: (None, False), 6: ("N/A", False), 7: ("X-W", True)}
    assert histories.fill_tickers(events, known.limit(0)).filter("ticker_filled").count() == 0
