"""What the plans must look like at scale, with automatic broadcasts switched off."""

from __future__ import annotations

import re

import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_auto_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


FILE_JOBS = {"r1_drift_scan", "r2_footnotes", "r3_roundtrip", "r3_reload", "r9_index", "t1_stream", "t2_late", "t2_late_side", "t2_late_count", "t4_landed_feed"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - FILE_JOBS))
def test_no_query_pairs_everything_with_everything(no_auto_broadcast, name):
    text = plan(catalog.QUERIES[name](no_auto_broadcast, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_panel_shuffles_each_event_once_for_prices(no_auto_broadcast):
    """Only the calendar is broadcast; the lookup keys on ticker and session together."""
    text = plan(catalog.QUERIES["v2_panel"](no_auto_broadcast, SF))
    broadcasts = re.findall(r"BroadcastHashJoin \[([^\]]*)\]", text)
    assert broadcasts and all(re.match(r"(day|date|cal_date)#", b) for b in broadcasts)
    assert re.search(r"hashpartitioning\(ticker#\d+, entry_t#\d+L?", text)
    assert "MapInPandas" not in text and "ArrowEvalPython" not in text


def test_event_build_never_multiplies_owners_by_trades(no_auto_broadcast):
    """Every raw side is aggregated below the join that would fan it out."""
    text = plan(catalog.QUERIES["v5_events"](no_auto_broadcast, SF))
    assert text.count("min(struct") >= 3
    assert text.count("SortMergeJoin") >= 2


def test_scans_read_only_what_they_use(no_auto_broadcast):
    text = plan(catalog.QUERIES["a3_codes"](no_auto_broadcast, SF))
    assert "o_totalprice" not in text
    text = plan(catalog.QUERIES["r6_calendar"](no_auto_broadcast, SF))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"l_shipdate"}


def test_footnote_text_is_not_shuffled(no_auto_broadcast):
    text = plan(catalog.QUERIES["j2_footnote_or"](no_auto_broadcast, SF))
    for exchange in re.findall(r"Exchange hashpartitioning\([^)]*\)", text):
        assert "FOOTNOTE_TXT" not in exchange
    below = optimized(catalog.QUERIES["j2_footnote_or"](no_auto_broadcast, SF))
    assert "RLIKE" in below.upper()


def test_top_k_and_sample_do_not_sort_everything(no_auto_broadcast):
    for name in ("k1_topk", "f11_sample"):
        assert "TakeOrderedAndProject" in plan(catalog.QUERIES[name](no_auto_broadcast, SF))
