from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm import prefix_forest as forest

SCHEMA = "vec_id long, embedding array<double>, rep string, name int, query string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1, None, "y") for i, v in rows], SCHEMA).repartition(4)


def found(df, **options):
    out: dict[int, list] = {}
    for r in sorted(forest.nearest(df, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def brute(rows, every=20, k=20):
    out = {}
    for q, v in rows:
        if q % every == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def same(got, want):
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items()}
    for q, near in want.items():
        assert np.allclose([s for _, s in near], [s for _, s in got[q]], rtol=1e-12, atol=1e-12)


def recall(got, want):
    return sum(len({i for i, _ in near} & {i for i, _ in got[q]}) for q, near in want.items()) / sum(map(len, want.values()))


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    heads = rng.standard_normal((60, 24))
    points = heads[rng.integers(0, 60, 4000)] + 0.5 * rng.standard_normal((4000, 24))
    points *= rng.uniform(0.5, 1.0, (4000, 1))  # lengths differ: inner products are not angles
    return [(i, [round(float(x), 6) for x in v]) for i, v in enumerate(points)]


@pytest.mark.parametrize("part_rows", [20_000, 300])
def test_recall_against_all_products(text_spark, clustered, part_rows):
    want = brute(clustered)
    got = found(table(text_spark, clustered), part_rows=part_rows)
    assert set(got) == set(want) and all(len(near) == 20 for near in got.values())
    assert recall(got, want) >= 0.93
    points = dict(clustered)
    assert all(abs(s - float(np.dot(points[q], points[i]))) < 1e-9 for q, near in got.items() for i, s in near)


def test_a_low_target_looks_at_less(text_spark, clustered):
    """A query stops sooner; what it finds still is whole, and in order."""
    got = found(table(text_spark, clustered), target=0.3)
    assert all(len(near) == 20 and near == sorted(near, key=lambda x: (-x[1], x[0])) for near in got.values())
    assert 0.25 < recall(got, brute(clustered))


def test_copies_stand_by_their_smallest_ids(text_spark):
    """A third of all rows is one vector: each query among them gets its copies, by id."""
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(700)] + [(700 + i, list(np.round(rng.standard_normal(3), 3))) for i in range(900)]
    want = brute(rows)
    got = found(table(text_spark, rows + rows[:50]), part_rows=200)
    assert recall(got, want) > 0.97
    for q in range(0, 700, 20):
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] if recall({q: got[q]}, {q: want[q]}) == 1 else True


def test_small_tables_are_searched_whole(text_spark):
    rng = np.random.default_rng(6)
    for n in (1, 2, 15, 60):
        rows = [(20 * i, list(np.round(rng.standard_normal(5), 4))) for i in range(n)]
        want = brute(rows)
        same(found(table(text_spark, rows)), {q: near for q, near in want.items() if near})


def test_odd_rows(text_spark):
    rng = np.random.default_rng(7)
    fine = [(i, list(np.round(rng.standard_normal(4), 3))) for i in range(50)]
    odd = [(None, [1, 2, 3, 4]), (60, None), (80, []), (100, [0, 0, 0, 0]), (120, [1, None, 2, 3]), (140, [float("nan"), 1, 1, 1]), (160, [float("inf"), 1, 1, 1]), (-20, [-0.0, 1, 0, 0])]
    shorter = [(70, [2.0, 1.0])]  # as if filled up with zeros
    twice = [(33, [9.0, 9.0, 9.0, 9.0]), *fine[:5]]  # the smaller vector of id 33 counts
    assert twice[0][1] > fine[33][1]
    rows = [*fine, (-20, [0.0, 1.0, 0.0, 0.0]), (70, [2.0, 1.0, 0.0, 0.0])]
    same(found(table(text_spark, [*fine, *odd, *shorter, *twice])), brute(rows))


def test_empty_tables(text_spark):
    assert found(table(text_spark, [])) == {} == found(table(text_spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0])])) == found(table(text_spark, [(20, None)]))


def test_ties_go_to_the_smaller_id(text_spark):
    rows = [(i, [1.0, float(i % 3 - 1)]) for i in range(90)]
    same(found(table(text_spark, rows)), brute(rows))


def test_prefixes_and_ascent():
    rng = np.random.default_rng(2)
    points = rng.standard_normal((400, 10))
    keys = forest.strings(points, 3)
    assert (keys >> forest.TREE_SHIFT == np.arange(forest.TREES)).all()
    depths = 3
    for q in range(5):
        counts = np.array([[(keys[:, t] >> forest.shift_of(d) == keys[q, t] >> forest.shift_of(d)).sum() for d in range(1, depths + 1)] for t in range(forest.TREES)])
        rows = forest.ascent(counts)
        assert (np.diff(rows) >= 0).all() and rows[-1] == counts[:, 0].sum()
        met = forest.met_at(keys[q], keys, depths)
        for goal in (50, 300, 900):
            level, trees = forest.stop(counts, goal)
            if not level:
                assert rows[-1] < goal
                continue
            # Below the nodes reached: by prefix, and by the step at which a row is met.
            reach = np.zeros(400, bool)
            for t in range(forest.TREES):
                depth = level if t < trees else level + 1
                if depth <= depths:
                    reach |= keys[:, t] >> forest.shift_of(depth) == keys[q, t] >> forest.shift_of(depth)
            assert (reach == (met <= (depths - level) * forest.TREES + trees - 1)).all()


def test_the_goal_is_the_smallest_that_finds_enough():
    samples = [(np.array([10, 40, 90]), np.array([0, 1, 2, 3])), (np.array([20, 50, 70]), np.array([1, 1, 1, 1]))]
    assert forest.measured_goal(samples, 5, 100, 0.1) == 5
    goal = forest.measured_goal(samples, 5, 100, 0.74)
    assert 20 < goal <= 40 * 1.1
    assert forest.measured_goal(samples, 5, 100, 1.0) > 90 and forest.measured_goal(samples, 5, 60, 1.0) == float("inf")
    assert forest.measured_goal([], 5, 100, 0.9) == 5
