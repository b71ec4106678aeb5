"""The feeds from landed tables and with corrections."""

from __future__ import annotations

import datetime as dt
import json
import random
from types import SimpleNamespace

import pytest
from conftest import FLAT_DEFAULTS, FLAT_SCHEMA, rows
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.operators import collapse, flatten
from tidemark.plans import events as event_plans
from tidemark.schemas import EVENT_COLUMNS
from tidemark.streaming import corrections, feed, landed

DAY = dt.date(2024, 3, 1)
SUB = "ACCESSION_NUMBER string, FILING_DATE string, PERIOD_OF_REPORT string, DOCUMENT_TYPE string, ISSUERCIK string, ISSUERNAME string, ISSUERTRADINGSYMBOL string, AFF10B5ONE string, landed date"
OWN = "ACCESSION_NUMBER string, RPTOWNERCIK string, RPTOWNERNAME string, RPTOWNER_RELATIONSHIP string, RPTOWNER_TITLE string, landed date"
TRN = (
    "ACCESSION_NUMBER string, NONDERIV_TRANS_SK long, TRANS_DATE string, TRANS_CODE string, TRANS_SHARES double, TRANS_PRICEPERSHARE double, "
    "TRANS_PRICEPERSHARE_FN string, TRANS_ACQUIRED_DISP_CD string, SHRS_OWND_FOLWNG_TRANS double, DIRECT_INDIRECT_OWNERSHIP string, landed date"
)


def on(n):
    return DAY + dt.timedelta(days=n)


def text(n):
    return on(n).strftime("%d-%b-%Y").upper()


def sub(a, n, flag=None, date=None):
    return (a, date or text(n), text(n), "4", "77", "Gadget", "GDG", flag, on(n))


def own(a, who, n, title=None):
    return (a, who, f"Name {who}", "Director", title, on(n))


def trn(a, sk, n):
    return (a, sk, text(n), "P", 5.0, 2.0, None, "A", 9.0, "D", on(n))


def land(spark, root, subs, owns, trns):
    for name, data, schema in (("SUBMISSION", subs, SUB), ("REPORTINGOWNER", owns, OWN), ("NONDERIV_TRANS", trns, TRN)):
        landed.land_drop(spark.createDataFrame(data, schema).coalesce(1), root, name)


def run(spark, root, **options):
    empty = {n: spark.createDataFrame([], s).schema for n, s in (("SUBMISSION", SUB), ("REPORTINGOWNER", OWN), ("NONDERIV_TRANS", TRN))}
    sub_, own_, trn_ = (landed.read_landed(spark, root, n, empty[n]) for n in ("SUBMISSION", "REPORTINGOWNER", "NONDERIV_TRANS"))
    events = landed.landed_events(sub_, own_, trn_, delay="2 days", span="10 days", **options)
    feed.finish_feed(landed.start_landed(events, f"{root}/out", f"{root}/checkpoint"))
    return landed.read_emitted(spark, f"{root}/out")


END = ([sub("END", 400)], [own("END", "1", 400)], [trn("END", 1, 400)])


def test_tables_of_a_filing_land_in_different_drops(spark, tmp_path):
    root = str(tmp_path)
    # B's owners on two days; C's owner too late; D bought nothing; E's filing date is not one; F has an owner before its filing.
    subs = [sub("A", 0), sub("B", 1), sub("C", 2), sub("D", 2), sub("E", 3, date="junk"), sub("F", 20)]
    owns = [own("A", "2", 0, "CFO"), own("A", "1", 0), own("B", "5", 3), own("D", "1", 2), own("E", "1", 3), own("F", "9", 10)]
    trns = [trn("A", 1, 4), trn("A", 2, 4), trn("B", 1, 1), trn("C", 1, 2), trn("E", 1, 3), trn("F", 1, 30)]
    land(spark, root, subs, owns, trns)
    first = run(spark, root)
    assert first.count() == 0  # partners may still land
    late = [own("B", "3", 11, "VP"), own("C", "4", 40)]
    land(spark, root, END[0], [*late, *END[1]], END[2])
    out = run(spark, root)
    batch = event_plans.purchase_events(
        spark.createDataFrame(subs, SUB), spark.createDataFrame(owns + late, OWN), spark.createDataFrame(trns, TRN)
    )
    owned = out.filter("owned").select(*EVENT_COLUMNS)
    assert rows(owned, "accession", "txn_sk") == rows(batch.filter("accession <> 'C'"), "accession", "txn_sk")
    assert [(r.accession, r.owned, r.n_reporting_owners, r.pairs) for r in out.filter("NOT owned").collect()] == [("C", False, 0, 1)]
    settled = landed.settle_ownerless(out, spark.read.parquet(f"{root}/REPORTINGOWNER"))
    assert rows(settled, "accession") == rows(batch.filter("accession = 'C'"), "accession")


def test_planned_filings_by_footnote(spark, tmp_path):
    root = str(tmp_path)
    land(spark, root, [sub("A", 0), sub("B", 0), sub("G", 0, flag="1")] + END[0], [own(a, "1", 0) for a in "ABG"] + END[1], [trn(a, 1, 0) for a in "ABG"] + END[2])
    notes = spark.createDataFrame([("A", "under a 10b5-1 plan")], "ACCESSION_NUMBER string, FOOTNOTE_TXT string")
    out = run(spark, root, footnotes=notes)
    assert {r.accession: r.is_10b5_1 for r in out.collect()} == {"A": True, "B": False, "G": True}


VERSIONED = FLAT_SCHEMA + ", landed date"


def flat_row(a, filed, lands, **extra):
    return {**FLAT_DEFAULTS, "accession": a, "filing_date_raw": text(filed) if isinstance(filed, int) else filed, "landed": on(lands), **extra}


def drop(spark, root, data):
    df = spark.createDataFrame(data, VERSIONED)
    df.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = feed.read_feed(spark, f"{root}/in", df.schema)
    feed.finish_feed(corrections.start_versions(corrections.event_versions(stream, keep_days=10, delay="1 day"), f"{root}/out", f"{root}/checkpoint"))
    feed.finish_feed(corrections.start_versions(corrections.late_rows(stream, keep_days=10), f"{root}/late", f"{root}/late-checkpoint"))
    return spark.read.parquet(f"{root}/out"), spark.read.schema(VERSIONED).parquet(f"{root}/late")


def test_more_rows_correct_an_event_and_late_ones_are_kept(spark, tmp_path):
    root = str(tmp_path)
    one = [flat_row("A", 0, 0, insider_id="5", title="VP"), flat_row("B", 0, 0), flat_row("A", 0, 0, txn_sk=11)]
    two = [flat_row("A", 0, 6, insider_id="3", relationship="Officer"), flat_row("C", 3, 6)]
    three = [flat_row("A", 0, 30, insider_id="1", title="CEO"), flat_row("D", 29, 30), flat_row("B", 0, 10, insider_id="7"), flat_row("Z", "junk", 30)]
    four = [flat_row("E", 70, 70)]
    drop(spark, root, one)
    versions, _ = drop(spark, root, two)
    assert {(r.event, r.version): r.n_reporting_owners for r in versions.collect() if '"A"' in r.event} == {
        ('{"accession":"A","txn_sk":10}', 1): 1, ('{"accession":"A","txn_sk":10}', 2): 2, ('{"accession":"A","txn_sk":11}', 1): 1,
    }
    drop(spark, root, three)
    versions, late = drop(spark, root, four)
    assert [(r.accession, r.insider_id) for r in late.collect()] == [("A", "1")]
    current = {(r.accession, r.txn_sk): r for r in corrections.corrected_events(versions).collect()}
    a = current["A", 10]
    assert (a.insider_id, a.title, a.n_reporting_owners, a.is_officer, a.is_director) == ("3", "VP", 2, True, True)
    everything = spark.createDataFrame([r for d in (one, two, three, four) for r in d if r["accession"] != "Z"], VERSIONED)
    merged = corrections.corrected_events(versions, late)
    assert rows(merged, "accession", "txn_sk") == rows(event_plans.normalize(everything), "accession", "txn_sk")


def test_the_state_of_a_closed_event_is_cleared(spark, tmp_path):
    """Rows that claim an old day, in a drop far out of order, find no state: they begin version 1 again instead of being added twice."""
    root = str(tmp_path)
    drop(spark, root, [flat_row("A", 0, 0)])
    drop(spark, root, [flat_row("B", 100, 100)])
    drop(spark, root, [flat_row("C", 200, 200)])
    progress = spark.read.parquet(f"{root}/out")
    assert sorted(r.version for r in progress.collect()) == [1, 1, 1]
    state = spark.read.format("statestore").option("path", f"{root}/checkpoint").option("stateVarName", "held").load()
    assert {r.key.event for r in state.collect()} == {'{"accession":"C","txn_sk":10}'}


def test_a_drop_has_a_file_per_day_whatever_the_tasks(spark, tmp_path):
    rows_in = spark.range(400).repartition(8).selectExpr("id", "date_add(date'2024-03-01', CAST(id % 2 AS INT)) AS landed")
    landed.land_drop(rows_in, str(tmp_path), "SUBMISSION")
    files = list(tmp_path.rglob("*.parquet"))
    assert len(files) == 2 and spark.read.parquet(f"{tmp_path}/SUBMISSION").count() == 400


def test_an_event_costs_one_read_one_write_and_one_timer():
    """The processor takes plain rows: no table is built per event, and the timer is set when the event is new."""
    calls = []
    held = SimpleNamespace(get=lambda: calls.append("get") or stored, update=lambda v: calls.append("update") or out.append(v))
    stored, out = None, []
    processor = corrections.Corrections(10)
    processor.init(SimpleNamespace(getValueState=lambda *_: held, registerTimer=lambda at: calls.append(at)))
    place = collapse.OWNER_COLUMNS.index("title")
    lead = lambda owner, title: json.dumps([title if k == place else owner if k == 0 else None for k in range(len(collapse.LEAD_COLUMNS))])
    some = [Row(lead=lead("7", "VP"), roles=1, close_ms=99), Row(lead=lead("3", None), roles=4, close_ms=99)]
    (first,) = processor.handleInputRows(("E",), iter(some), None)
    assert calls == ["get", 99, "update"] and (first.event, first.n_reporting_owners, first.version) == ("E", 2, 1)
    assert first.lead[0] == "3" and first.titled[0] == "7" and [k for k, had in enumerate(first.roles) if had] == [0, 2]
    stored = out[0]
    (second,) = processor.handleInputRows(("E",), iter([Row(lead=lead("1", None), roles=0, close_ms=99)]), None)
    assert calls[3:] == ["get", "update"] and (second.lead[0], second.n_reporting_owners, second.version) == ("1", 3, 2) and second.roles == first.roles


def test_order_of_leading_rows_is_sparks(spark):
    rng = random.Random(4)
    pool = {"double": [None, "1.0", "2.5", "10.0", "-3.0", "NaN", "1.0E10"], "string": [None, "", "a", "b", "é", "𝒳", "A"], "date": [None, "2020-01-02", "2021-01-01"], "boolean": [None, "false", "true"], "bigint": [None, "5"]}
    kinds = [corrections._TYPES[c] for c in collapse.LEAD_COLUMNS]
    for _ in range(5):
        data = [[rng.choice(pool[k]) if j in (0, i % 19) else pool[k][0] for j, k in enumerate(kinds)] for i in range(60)]
        df = spark.createDataFrame([(x,) for x in data], "x array<string>")
        cells = [F.col("x")[k].cast(t).alias(c) for k, (c, t) in enumerate(zip(collapse.LEAD_COLUMNS, kinds))]
        lowest = df.select("x", F.struct(*cells).alias("s")).groupBy().agg(F.min("s").alias("s")).first()["s"]
        mine = min(data, key=corrections.order_key)
        typed = spark.createDataFrame([(mine,)], "x array<string>").select(F.struct(*cells).alias("s")).first()["s"]
        assert str(typed) == str(lowest)


def test_partials_merge_to_the_whole(spark):
    data = [{**FLAT_DEFAULTS, "accession": f"A{i % 3}", "insider_id": str(i * 7 % 11), "title": None if i % 2 else f"T{i}", "txn_sk": i % 2} for i in range(40)]
    typed = flatten.typed_rows(spark.createDataFrame(data, FLAT_SCHEMA))
    halves = [collapse.partial_events(typed.filter(F.col("insider_id").cast("int") % 2 == k)) for k in (0, 1)]
    merged = collapse.finish_partials(collapse.merge_partials(halves[0].unionByName(halves[1])))
    assert rows(merged, "accession", "txn_sk") == rows(collapse.collapse_cofilers(typed), "accession", "txn_sk")


@pytest.mark.parametrize("keep", [0, 10])
def test_late_and_in_time_share_the_rows(spark, keep):
    data = [flat_row("A", 0, n) for n in range(20)] + [flat_row("B", "junk", 3)]
    df = spark.createDataFrame(data, VERSIONED)
    assert corrections.late_rows(df, keep).count() == 19 - keep and df.filter(corrections._in_time(keep)).count() == keep + 1


def test_a_join_of_streams_has_one_store_a_partition(spark, tmp_path):
    """A store is opened and committed in every batch, so four a partition and join are the larger part of a batch's time."""
    root = str(tmp_path)
    land(spark, root, [sub("A", 0)] + END[0], [own("A", "1", 0)] + END[1], [trn("A", 1, 0)] + END[2])
    assert [r.accession for r in run(spark, root).collect()] == ["A"]
    named = {f.name for f in (tmp_path / "checkpoint/state").glob("*/[0-9]*/*")}
    assert "1.changelog" in named and not [n for n in named if n.startswith(("left-", "right-"))]
