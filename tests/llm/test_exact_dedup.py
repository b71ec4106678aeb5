from __future__ import annotations

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.llm import exact_dedup


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
@pytest.mark.parametrize("top", [1 << 10, 1 << 47])
def test_golomb_code_round_trip(n, top):
    values = np.unique(np.random.default_rng(n).integers(0, top, n))
    rice, code = exact_dedup.golomb_encode(values)
    assert exact_dedup.golomb_decode(rice, code, len(values)).tolist() == values.tolist()
    assert len(code) <= len(values) * (np.log2(top / max(1, len(values))) + 3) / 8 + 16


def test_against_grouping(frame):
    rng = random.Random(1)
    texts = ["Alpha", "alpha", "ALPHÄ", "alphä", "", None, "a b", "a  b", "z" * 9000]
    rows = [(i, rng.choice(texts)) for i in range(400)] + [(1000 + i, f"unique {i}") for i in range(300)]
    got = {r.doc_id: r for r in exact_dedup.duplicates(frame(rows).repartition(9), owner_rows=90).collect()}
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups: dict[str, list[int]] = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    for i, t in rows:
        own = groups[low(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(own), len(own), i == max(own))
    assert len(got) == len(rows)


def test_only_suspects_can_be_grouped(frame):
    """Fingerprints in different blocks and owners meet; a text of one row alone never waits for a partner."""
    rows = [(i, f"text {i // 2}") for i in range(200)]
    got = exact_dedup.duplicates(frame(rows).repartition(20), owner_rows=11).toPandas()
    assert (got.group_size == 2).all() and got.kept.sum() == 100


def test_odd_rows(odd_docs):
    got = exact_dedup.duplicates(odd_docs)
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    seven = [r for r in rows if r.text_sha256 == next(r for r in rows if r.doc_id == 2).text_sha256]
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in seven) == [(0, 2, 4, False), (1, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True)]
    blank = [r for r in rows if r.group_size == 4 and r.keep_id == 4]
    assert len(blank) == 4 and sum(r.kept for r in blank) == 1
    assert got.limit(0).count() == exact_dedup.duplicates(odd_docs.limit(0)).count() == 0


def test_kept_rows_keep_their_columns(odd_docs):
    kept = exact_dedup.drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")) for r in odd_docs.select("text").collect()]
    assert kept.count() == len(set(texts))


def test_null_ids_only(frame):
    docs = frame([(None, "same"), (None, "same"), (None, "Same"), (None, "other")])
    got = exact_dedup.duplicates(docs).toPandas()
    assert sorted(got.group_size) == [1, 3, 3, 3] and got.keep_id.isna().all() and got.kept.sum() == 2
    assert exact_dedup.drop_duplicates(docs).count() == 2


def test_shared_prints_are_those_of_more_than_one_row(text_spark):
    """Whether the rows lie in one block or in several, and however many owners there are."""
    prints = [3, 3, 7, (1 << 48) - 1, 11, 11, 11, 0, (1 << 47), (1 << 47)]
    rows = text_spark.createDataFrame([(p,) for p in prints], "print long")
    for parts in (1, 10):
        for owners in (1, 3, 50):
            got = exact_dedup._shared_prints(rows.repartition(parts), owners)
            assert sorted(r[0] for r in got.collect()) == [3, 11, 1 << 47]


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_a_third_of_the_rows_are_copies_without_an_id(frame, most):
    rows = [(None, "Same text") for _ in range(400)] + [(i, f"text {i % 500}") for i in range(800)] + [(5, "text 5")] * 30
    docs = frame(rows).repartition(7)
    got = exact_dedup.duplicates(docs, owner_rows=100, most=most).toPandas()
    hot = got[got.group_size == 400]
    assert len(hot) == 400 and hot.kept.sum() == 1 and hot.doc_id.isna().all() and len(got) == len(rows)
    assert got.kept.sum() == 501
    kept = exact_dedup.drop_duplicates(docs, most=most)
    assert sorted(str(r.text).lower() for r in kept.collect()) == sorted({t.lower() for _, t in rows})


def test_texts_without_a_copy_stay_where_they_are(frame):
    """The exchange of texts holds the suspects' only."""
    docs = frame([(i, f"text {i}") for i in range(900)] + [(1000 + i, "copy") for i in range(40)]).repartition(6)
    keyed = docs.select(exact_dedup.normalised(F.col("text")).alias("norm")).withColumn("print", F.shiftrightunsigned(F.xxhash64("norm"), 16))
    shared = exact_dedup._shared_prints(keyed, 2)
    assert shared.count() == 1
    assert exact_dedup._meet(keyed, shared, "print", "left_semi", 10).count() == 40
    plan = exact_dedup._meet(keyed, shared, "print", "left_semi", 10)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
