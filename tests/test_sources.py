from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.sources import filings, index, prices, quarters, store


def put(root, quarter, table, text):
    folder = root / quarter
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{table}.tsv").write_text(text)


def test_drifting_columns_are_matched_by_name(spark, tmp_path):
    put(tmp_path, "2020q1", "SUBMISSION", "ACCESSION_NUMBER\tDOCUMENT_TYPE\tFILING_DATE\nA\t4\t01-JAN-2020\n")
    put(tmp_path, "2023q2", "SUBMISSION", "FILING_DATE\tAFF10B5ONE\tACCESSION_NUMBER\tEXTRA\n02-APR-2023\t1\tB\tx\n")
    put(tmp_path, "2023q3", "SUBMISSION", "FILING_DATE\tAFF10B5ONE\tACCESSION_NUMBER\tEXTRA\n03-JUL-2023\t\tC\ty\n")
    put(tmp_path, "2023q3", "OWNER_SIGNATURE", "ACCESSION_NUMBER\nZ\n")
    out = filings.scan_table(spark, str(tmp_path), "SUBMISSION", lineage=True)
    a, b, c = rows(out, "ACCESSION_NUMBER")
    assert (a["FILING_DATE"], a["DOCUMENT_TYPE"], a["AFF10B5ONE"]) == ("01-JAN-2020", "4", None)
    assert (b["FILING_DATE"], b["DOCUMENT_TYPE"], b["AFF10B5ONE"], b["EXTRA"]) == ("02-APR-2023", None, "1", "x")
    assert c["AFF10B5ONE"] is None and c["source_file"].endswith("2023q3/SUBMISSION.tsv")


def test_layouts_all_without_a_known_column_get_it_as_null(spark, tmp_path):
    put(tmp_path, "2010q1", "SUBMISSION", "ACCESSION_NUMBER\tDOCUMENT_TYPE\nA\t4\n")
    [r] = rows(filings.scan_table(spark, str(tmp_path), "SUBMISSION"), "ACCESSION_NUMBER")
    assert r["AFF10B5ONE"] is None and r["ISSUERCIK"] is None


def test_one_scan_per_layout_not_per_quarter(spark, tmp_path):
    for i in range(1, 5):
        put(tmp_path, f"2021q{i}", "SUBMISSION", f"ACCESSION_NUMBER\tDOCUMENT_TYPE\nA{i}\t4\n")
    plan = filings.scan_table(spark, str(tmp_path), "SUBMISSION")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_quoted_and_ragged_lines_do_not_stop_the_scan(spark, tmp_path):
    put(tmp_path, "2020q1", "FOOTNOTES", 'ACCESSION_NUMBER\tFOOTNOTE_ID\tFOOTNOTE_TXT\nA\tF1\t"a ""10b5-1"" plan"\nB\tF1\n')
    a, b = rows(filings.load_footnotes(spark, str(tmp_path), quote='"'), "ACCESSION_NUMBER")
    assert "10b5-1" in a["FOOTNOTE_TXT"] and b["FOOTNOTE_TXT"] is None


def test_malformed_lines_are_counted_per_file(spark, tmp_path):
    put(tmp_path, "2020q1", "FOOTNOTES", "ACCESSION_NUMBER\tFOOTNOTE_TXT\nA\tx\nB\nC\tx\ty\n")
    put(tmp_path, "2020q2", "FOOTNOTES", "ACCESSION_NUMBER\tFOOTNOTE_TXT\nD\tx\n")
    out = rows(filings.malformed_lines(spark, str(tmp_path), "FOOTNOTES"), "source_file")
    assert [(r["lines"], r["malformed"]) for r in out] == [(3, 2), (1, 0)]


def test_missing_table_is_an_error(spark, tmp_path):
    put(tmp_path, "2020q1", "SUBMISSION", "ACCESSION_NUMBER\nA\n")
    with pytest.raises(FileNotFoundError):
        filings.scan_table(spark, str(tmp_path), "REPORTINGOWNER")


def test_quarters_are_inclusive_and_empty_when_reversed(spark):
    labels = [r.label for r in quarters.quarter_range(spark, 2019, 3, 2020, 2).orderBy("label").collect()]
    assert labels == ["2019q3", "2019q4", "2020q1", "2020q2"]
    assert quarters.quarter_range(spark, 2020, 2, 2019, 3).count() == 0
    assert quarters.quarter_range(spark, 2020, 2, 2020, 2).count() == 1


def test_missing_quarters_of_landed_files(spark, tmp_path):
    for q in ("2019q3", "2020q1"):
        put(tmp_path, q, "SUBMISSION", "ACCESSION_NUMBER\nA\n")
    landed = quarters.landed_quarters(filings.landed_files(spark, str(tmp_path)))
    missing = quarters.missing_quarters(quarters.quarter_range(spark, 2019, 3, 2020, 2), landed)
    assert [r.label for r in missing.orderBy("label").collect()] == ["2019q4", "2020q2"]


def test_quarters_spanning_dates_have_no_gaps(spark):
    days = spark.createDataFrame([(dt.date(2020, 2, 9),), (dt.date(2020, 11, 1),), (None,)], "d date")
    assert [r.label for r in quarters.quarters_spanning(days, "d").orderBy("label").collect()] == [
        "2020q1", "2020q2", "2020q3", "2020q4",
    ]
    assert quarters.quarters_spanning(days.filter("d IS NULL"), "d").count() == 0


INDEX = """Description:           Daily Index of filings by Form Type
Form Type   Company Name                                                  CIK         Date Filed  File Name
---------------------------------------------------------------------------------------------------------
4           GADGET & CO  INC                                              1234        20240206    edgar/data/1234/0001-24-000007.txt
4/A         GADGET & CO  INC                                              1234        20240206    edgar/data/1234/0001-24-000008.txt
SC 13D      OTHER CORP                                                    99          2024-02-06  edgar/data/99/0002-24-000001.txt
4           EARLY BIRD LP                                                 7           20231229    edgar/data/7/0003-23-000001.txt
"""


def test_daily_index_keeps_new_filings_of_one_form(spark, tmp_path):
    (tmp_path / "form.idx").write_text(INDEX)
    entries = index.read_form_index(spark, str(tmp_path))
    assert sorted(r.form_type for r in entries.collect()) == ["4", "4", "4/A", "SC 13D"]
    [r] = rows(index.filings_since(entries, dt.date(2023, 12, 31)), "accession")
    assert (r["company"], r["cik"], r["accession"]) == ("GADGET & CO  INC", "1234", "0001-24-000007")
    assert r["filing_date"] == dt.date(2024, 2, 6)


def test_part_files_with_other_headers_are_matched_by_name(spark, tmp_path):
    folder = tmp_path / "2024q1" / "SUBMISSION.tsv"
    folder.mkdir(parents=True)
    (folder / "part-0.csv").write_text("ACCESSION_NUMBER\tDOCUMENT_TYPE\nA\t4\n")
    (folder / "part-1.csv").write_text("DOCUMENT_TYPE\tACCESSION_NUMBER\n3\tB\n")
    (folder / "part-2.csv").write_text("")
    got = rows(filings.scan_table(spark, str(tmp_path), "SUBMISSION"), "ACCESSION_NUMBER")
    assert [(r["ACCESSION_NUMBER"], r["DOCUMENT_TYPE"]) for r in got] == [("A", "4"), ("B", "3")]


def test_long_company_names_fill_their_column(spark):
    lines = [
        f"{'4':<12}{'N' * n:<62}{'77':<12}{'20240206':<12}edgar/data/77/A-{n}.txt" for n in (1, 60, 61, 62)
    ] + ["", "Form Type   Company Name", f"{'4':<12}{'NO DATE':<62}{'77':<12}unknown     edgar/data/77/X.txt"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = rows(index.parse_form_index(df), "accession")
    assert sorted((len(r["company"]), r["cik"], r["accession"]) for r in got) == [(n, "77", f"A-{n}") for n in (1, 60, 61, 62)]
    assert sorted(r.value for r in index.unparsed_lines(df).collect()) == sorted(lines[4:])


def test_wide_prices_turn_long(spark):
    wide = spark.createDataFrame(
        [(dt.date(2020, 1, 2), 1.0, 2.0, 5.0), (dt.date(2020, 1, 3), 1.5, None, 6.0)],
        "date date, AA_open double, AA_close double, BB_close double",
    )
    out = prices.wide_to_long(wide, ["AA", "BB", "CC"])
    assert [(r["ticker"], r["date"].day, r["open"], r["close"]) for r in rows(out, "ticker", "date")] == [
        ("AA", 2, 1.0, 2.0), ("BB", 2, None, 5.0), ("BB", 3, None, 6.0),
    ]
    assert prices.wide_to_long(wide, ["CC"]).count() == 0


def test_price_contract_limits_tickers_and_window(spark):
    px = spark.createDataFrame(
        [(t, dt.date(2020, 1, d), 1.0) for t in ("AA", "BB", "X-1") for d in (1, 2, 3)],
        "ticker string, date date, close double",
    )
    wanted = spark.createDataFrame([("AA",), ("X-1",), ("AA",), (None,)], "ticker string")
    out = prices.daily_closes(px, wanted, F.lit(dt.date(2020, 1, 2)), F.lit(dt.date(2020, 1, 3)))
    assert [(r["ticker"], r["date"].day) for r in rows(out, "date")] == [("AA", 2), ("AA", 3)]


def test_stored_events_prune_by_year(spark, tmp_path):
    ev = spark.createDataFrame([("A", dt.date(2020, 5, 1)), ("B", dt.date(2021, 5, 1)), ("C", None)], "accession string, filing_date date")
    path = str(tmp_path / "ev")
    store.write_events(ev, path)
    back = store.read_table(spark, path)
    assert back.count() == 3
    assert [r.accession for r in back.filter("filing_year = 2021").collect()] == ["B"]
