from __future__ import annotations

import random

import numpy as np
import pytest

from tidemark.llm import hamming
from tidemark.llm.queries import op2


def brute(rows, queries, k):
    out = {}
    for q, code in queries:
        near = sorted((bin((c ^ code) & (2**64 - 1)).count("1"), i) for i, c in set(rows) if i != q)
        out[q] = [(i, d) for d, i in near[:k]]
    return out


@pytest.mark.parametrize("chunk", [50_000, 60])
def test_against_all_distances(text_spark, chunk):
    rng = random.Random(1)
    base = [rng.getrandbits(64) - 2**63 for _ in range(40)]
    rows = [(i, rng.choice(base)) for i in range(60)]  # many equal codes
    rows += [(100 + i, rng.choice(base) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63))) for i in range(120)]
    rows += [(300 + i, rng.getrandbits(64) - 2**63) for i in range(150)] + [(900 + i, -1) for i in range(30)]
    wide = [(i, [c]) for i, c in rows]
    table = text_spark.createDataFrame(wide + wide[:9] + [(None, [5]), (7777, None)], "id long, code array<long>")
    queries = [r for r in rows if r[0] % 10 == 0]
    got = hamming.nearest_codes(table, table.filter("id % 10 = 0"), 7, chunk_codes=chunk, block_queries=11).collect()
    found: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.neighbour_id, r.distance))
    assert found == brute(rows, queries, 7)


def test_radii_cover_what_they_promise():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    index = hamming.SegmentIndex(codes[:, None])
    assert index.bounds[0] == (0, 0, index.bounds[0][2]) and sum(w for *_, w in index.bounds) == 64
    for code in codes[:20]:
        places, distance = index.nearest(np.array([code]), 5, np.ones(500, np.int64))
        every = np.bitwise_count(codes ^ code)
        assert sorted(distance)[:5] == sorted(every)[:5]
        within = distance.max()
        assert len(places) == len(set(places)) and (every[places] == distance).all() and (every < within).sum() == (distance < within).sum()


def test_sign_codes(text_spark):
    rows = [([0.5, -1.0, 2.0],), ([],), (None,), ([float("nan"), None, 1.0],), ([1.0] * 64,), ([1.0] * 80,)]
    got = [r[0] for r in text_spark.createDataFrame(rows, "v array<float>").select(hamming.sign_code("v")).collect()]
    assert got == [[5], [0], None, [4], [-1], [-1]]
    both = [r[0] for r in text_spark.createDataFrame(rows, "v array<float>").select(hamming.sign_code("v", 2)).collect()]
    assert both == [[5, 0], [0, 0], None, [4, 0], [-1, 0], [-1, (1 << 16) - 1]]


def test_few_and_no_rows(text_spark):
    make = lambda rows: text_spark.createDataFrame([(i, [c]) for i, c in rows], "id long, code array<long>")
    assert [tuple(r) for r in hamming.nearest_codes(make([(1, 0), (2, 3)]), make([(1, 0)]), 10).collect()] == [(1, 2, 2, 1)]
    assert hamming.nearest_codes(make([(1, 0)]), make([(1, 0)])).count() == 0
    assert hamming.nearest_codes(make([]), make([])).count() == hamming.nearest_codes(make([(1, 0)]), make([])).count() == 0


@pytest.mark.parametrize("chunk", [20_000, 40])
def test_vectors_of_any_length(text_spark, chunk):
    """Codes of several words, and columns named like the operator's own."""
    rng = random.Random(7)
    heads = [[rng.gauss(0, 1) for _ in range(150)] for _ in range(5)]
    data = [(i, [x if rng.random() < 0.9 else -x for x in rng.choice(heads)]) for i in range(200)]
    schema = "vec_id long, embedding array<double>, id int, code string, name string, chunk string"
    df = text_spark.createDataFrame([(i, v, 1, "a", None, "b") for i, v in data] + [(999, None, 1, "a", None, "b")], schema)
    got = {r.query_id: [] for r in op2(df, "").collect()}
    code = hamming.sign_code("embedding", 3)
    rows = df.select(quotes_id("vec_id"), code.alias("code"))
    found = hamming.nearest_codes(rows, rows.filter("id % 50 = 0"), 10, chunk_codes=chunk).collect()
    assert set(got) == {0, 50, 100, 150}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.neighbour_id, r.distance))
    apart = lambda a, b: sum((x > 0) != (y > 0) for x, y in zip(a, b))
    vectors = dict(data)
    for q, near in got.items():
        assert near == [(i, d) for d, i in sorted((apart(vectors[q], v), i) for i, v in data if i != q)[:10]]


def quotes_id(name):
    return hamming.F.col(name).cast("long").alias("id")


def test_a_bound_leaves_farther_codes_out():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 63, (300, 2)).astype(np.uint64)
    index = hamming.SegmentIndex(codes)
    every = np.bitwise_count(codes ^ codes[0]).sum(1)
    for limit in (0, 40, 55, 128):
        places, distance = index.nearest(codes[0], 1000, np.ones(300, np.int64), limit)
        assert sorted(places) == np.flatnonzero(every <= limit).tolist() and (distance == every[places]).all()
