"""Raw tables kept by landed quarter, and the headers of many files."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.catalog import feeds
from tidemark.plans import events as event_plans
from tidemark.sources import filings, landed_quarters


@pytest.fixture
def tables(spark, tmp_path):
    """Two hundred filings with two owners and a purchase each, in four quarters, each table loaded once."""
    base = spark.range(200).select(F.concat(F.lit("A-"), "id").alias("ACCESSION_NUMBER"), F.concat(F.lit("2020q"), F.col("id") % 4 + 1).alias("quarter"), "id")
    key = ["ACCESSION_NUMBER", "quarter"]
    subs = base.select(
        *key, F.lit("06-FEB-2020").alias("FILING_DATE"), F.lit("02-FEB-2020").alias("PERIOD_OF_REPORT"), F.lit("4").alias("DOCUMENT_TYPE"), F.lit("7").alias("ISSUERCIK"),
        F.lit("G").alias("ISSUERNAME"), F.lit("GDG").alias("ISSUERTRADINGSYMBOL"), F.lit(None).cast("string").alias("AFF10B5ONE"),
    )
    owns = base.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        *key, F.col("k").cast("string").alias("RPTOWNERCIK"), F.lit("N").alias("RPTOWNERNAME"), F.lit("Director").alias("RPTOWNER_RELATIONSHIP"), F.lit(None).cast("string").alias("RPTOWNER_TITLE")
    )
    trns = base.select(
        *key, F.col("id").alias("NONDERIV_TRANS_SK"), F.lit("02-FEB-2020").alias("TRANS_DATE"), F.lit("P").alias("TRANS_CODE"), F.lit(1.0).alias("TRANS_SHARES"), F.lit(2.0).alias("TRANS_PRICEPERSHARE"),
        F.lit(None).cast("string").alias("TRANS_PRICEPERSHARE_FN"), F.lit("A").alias("TRANS_ACQUIRED_DISP_CD"), F.lit(3.0).alias("SHRS_OWND_FOLWNG_TRANS"), F.lit("D").alias("DIRECT_INDIRECT_OWNERSHIP"),
    )
    mark = uuid.uuid4().hex
    made = {f"{n}_{mark}": df for n, df in (("sub", subs), ("own", owns), ("trn", trns))}
    for name, df in made.items():
        landed_quarters.load_quarters(df, name, str(tmp_path), buckets=4)
    yield spark, str(tmp_path), made
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def files(root, name):
    return {str(p): os.stat(p).st_mtime_ns for p in Path(root, name).rglob("*.parquet")}


def events(spark, made):
    return event_plans.purchase_events(*[spark.table(n) for n in made], colocated=True)


def test_a_quarter_loaded_twice_counts_once(tables):
    spark, root, made = tables
    first = rows(events(spark, made), "accession")
    assert len(first) == 200 and {r["n_reporting_owners"] for r in first} == {2}
    before = {n: files(root, n) for n in made}
    for name, df in made.items():
        landed_quarters.load_quarters(df.filter("quarter = '2020q2'"), name, root, buckets=4)
    assert rows(events(spark, made), "accession") == first
    for name in made:
        after = files(root, name)
        same = {p: t for p, t in before[name].items() if "quarter=2020q2" not in p}
        assert same and same == {p: t for p, t in after.items() if "quarter=2020q2" not in p}
        assert not {p for p in after if "quarter=2020q2" in p} & set(before[name])


def test_a_reload_replaces_what_the_quarter_held(tables):
    spark, root, made = tables
    name = next(n for n in made if n.startswith("own"))
    fewer = made[name].filter("quarter = '2020q1' AND RPTOWNERCIK = '1'")
    landed_quarters.load_quarters(fewer, name, root, buckets=4)
    counts = {r["quarter"]: r["n"] for r in spark.table(name).groupBy("quarter").agg(F.count("*").alias("n")).collect()}
    assert counts == {"2020q1": 50, "2020q2": 100, "2020q3": 100, "2020q4": 100}


def test_the_manifest_knows_every_load(tables):
    spark, root, made = tables
    name = next(n for n in made if n.startswith("sub"))
    landed_quarters.load_quarters(made[name].filter("quarter = '2020q3'"), name, root, buckets=4)
    seen = {(r["name"].split("_")[0], r["quarter"]): (r["rows"], r["loads"]) for r in landed_quarters.manifest(spark, root).collect()}
    assert seen["sub", "2020q3"] == (50, 2) and seen["own", "2020q3"] == (100, 1) and len(seen) == 12
    assert landed_quarters.incomplete_quarters(spark, root, list(made)).count() == 0
    landed_quarters.load_quarters(made[name].limit(3).withColumn("quarter", F.lit("2021q1")), name, root, buckets=4)
    (short,) = landed_quarters.incomplete_quarters(spark, root, list(made)).collect()
    assert short["quarter"] == "2021q1" and [n.split("_")[0] for n in short["missing"]] == ["own", "trn"]


def test_bucketed_tables_join_without_an_exchange(tables):
    spark, _, made = tables
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    try:
        text = events(spark, made)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Exchange" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_headers_of_many_files_take_a_bounded_number_of_jobs(spark, tmp_path):
    def jobs(n):
        root = tmp_path / str(n)
        for k in range(n):
            folder = root / f"q{k}"
            folder.mkdir(parents=True)
            names = "A\tACCESSION_NUMBER" if k % 2 else "ACCESSION_NUMBER\tB"
            blank = "\n" if k % 3 == 0 else ""
            (folder / "OTHER.tsv").write_text(f"{blank}{names}\n" + "\n".join(f"{k}\t{k}" for _ in range(3)) + "\n")
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "headers")
        found = filings.scan_table(spark, str(root), "OTHER")
        started = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert found.count() == 3 * n and found.filter("A IS NULL").count() == 3 * ((n + 1) // 2)
        return started

    assert jobs(6) <= jobs(100) == jobs(250) < 20


def test_buckets_grow_with_the_tables():
    assert [landed_quarters.buckets_for(n) for n in (0, 16_000_000, 16_000_001, 216_000_000)] == [8, 8, 9, 108]


def test_each_table_is_built_once_for_both_loads(spark, monkeypatch, tmp_path):
    """The loads read stored rows, not the joins and aggregates the tables come from."""
    n = spark.range(20)
    made = {
        "orders": n.selectExpr("id AS o_orderkey", "id % 3 AS o_custkey", "timestamp'1996-05-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority"),
        "customer": n.selectExpr("id AS c_custkey", "'c' AS c_name"),
        "supplier": n.selectExpr("id AS s_suppkey", "'s' AS s_name"),
        "documents": n.selectExpr("id AS doc_id", "'text' AS text"),
        "lineitem": n.selectExpr(
            "id AS l_orderkey", "id AS l_partkey", "id % 5 AS l_suppkey", "1 AS l_linenumber", "2.0D AS l_quantity", "3.0D AS l_extendedprice", "0.0D AS l_discount",
            "0.0D AS l_tax", "'A' AS l_returnflag", "'O' AS l_linestatus", "timestamp'1996-05-02' AS l_shipdate",
        ),
    }
    for name, rows_of in made.items():
        rows_of.write.parquet(f"{tmp_path}/{name}.parquet")
    seen = []
    monkeypatch.setattr(feeds.landed_quarters, "load_quarters", lambda rows, name, root, buckets: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()))
    with pytest.raises(AnalysisException):
        catalog.QUERIES["r3_reload"](spark, str(tmp_path))
    assert len(seen) == 6 and not any("Join" in plan or "Aggregate" in plan for plan in seen)
