from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import walsh


def brute(rows, clusters=8, rounds=10, seed=3):
    """The contract in plain integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for k in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == k]
            if own:
                centres[k] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    inertia = [sum(d for d, c in found if c == k) for k in range(len(centres))]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), c, d, inertia[c], sum(inertia), name[c]) for (i, _), (d, c) in zip(kept, found))


def run(table, **options):
    return sorted((str(r[0]), *r[1:]) for r in walsh.cluster(table, **options).collect())


SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster string, distance int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "own", None, 5) for i, v in rows], SCHEMA).repartition(3)


def vectors(rng, n, centres=12, spread=0.3):
    heads = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(centres)]
    return [[float(np.float32(x + rng.gauss(0, spread))) for x in rng.choice(heads)] for _ in range(n)]


def test_against_plain_integers(text_spark):
    rng = random.Random(4)
    rows = list(enumerate(vectors(rng, 300)))
    rows += [(400 + i, rows[0][1]) for i in range(60)] + rows[:20]  # a hot vector, repeated rows
    rows += [(None, rows[1][1]), (None, None), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [float("nan")] * 64)]
    rows += [(905, [None] * 64), (906, [float("inf")] + [0.0] * 63), (907, [0.0] * 64), (908, [-0.0] * 64), (7, rows[9][1]), (909, [8191.0] * 64), (910, [-8191.0] * 64)]
    assert run(table(text_spark, rows)) == brute(rows)


def test_components_in_double_precision(text_spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(40)] + [(99, [0.5 / 1024, -1e-300] + [1 - 2**-53] * 62)]
    df = text_spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert run(df) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 5, 8])
def test_few_rows(text_spark, n):
    rows = list(enumerate(vectors(random.Random(n), n)))
    assert run(table(text_spark, rows)) == brute(rows)


def test_ties_take_the_smaller_centroid(text_spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(30)]
    got = run(table(text_spark, rows), rounds=2)
    assert got == brute(rows, rounds=2) and len({r[1] for r in got}) == 2  # equal centroids: the later ones stay empty and unchanged


def test_search_is_exact_and_leaves_work_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (9, 64))
    centres[5] = centres[2]
    points = np.concatenate([centres[rng.integers(0, 9, 2000)] + rng.integers(-60, 60, (2000, 64)), rng.integers(-(1 << 23) + 1, 1 << 23, (500, 64)), centres])
    best, distance, taken = walsh.nearest(walsh.transform(points), walsh.transform(centres))
    every = ((points[:, None] - centres) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert taken < 0.6 * every.size * 64


def test_the_transform_keeps_distances():
    matrix = walsh.transform_matrix()
    assert (matrix @ matrix.T == 64 * np.eye(64)).all() and set(np.unique(matrix)) == {-1, 1}
    assert ((matrix[:, 1:] != matrix[:, :-1]).sum(1) == np.arange(64)).all()


def test_too_large_components_are_an_error(text_spark):
    with pytest.raises(Exception, match="8192 or more"):
        run(table(text_spark, [(1, [8192.0] * 64), (2, [1.0] * 64)]))
