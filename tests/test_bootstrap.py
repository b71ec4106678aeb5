from __future__ import annotations

import hashlib

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import bootstrap
from tidemark.plans import curve as curves


@pytest.fixture(scope="module")
def sample(spark):
    """2,000 skewed values in one group and 40 in another, keyed by (accession, txn_sk)."""
    rng = np.random.default_rng(3)
    data = [("big", f"a{i}", 1, float(v)) for i, v in enumerate(rng.exponential(1.0, 2_000))]
    data += [("small", f"b{i}", 1, float(v)) for i, v in enumerate(rng.normal(5, 2, 40))]
    data += [("small", "none", 1, None)]
    return spark.createDataFrame(data, "grp string, accession string, txn_sk int, x double")


def means(df, n_boot=800, **options):
    out = bootstrap.resampled_means(df, "x", ["grp"], n_boot, **options)
    return {(r.grp, r.replicate): r.mean for r in out.collect()}


def test_every_group_and_replicate_is_there_once(sample):
    out = bootstrap.resampled_means(sample, "x", ["grp"], 777)
    assert out.count() == out.select("grp", "replicate").distinct().count() == 2 * 777


def test_same_seed_same_means_whatever_the_partitioning(sample):
    one = means(sample.coalesce(1))
    two = means(sample.repartition(13))
    assert one.keys() == two.keys()
    assert all(one[k] == pytest.approx(two[k], abs=1e-12) for k in one)
    assert means(sample, seed=9) != one


@pytest.mark.parametrize("chunk_values", [100, 1 << 17])
def test_means_spread_like_the_sampling_distribution(sample, chunk_values):
    """Chunked or not, mean and deviation of the replicates match theory."""
    got = means(sample, 2_000, chunk_values=chunk_values)
    x = np.array([r.x for r in sample.filter("grp = 'big'").collect()])
    reps = np.array([v for (g, _), v in got.items() if g == "big"])
    se = x.std() / np.sqrt(len(x))
    assert reps.mean() == pytest.approx(x.mean(), abs=4 * se / np.sqrt(len(reps)))
    assert reps.std() == pytest.approx(se, rel=0.1)


def test_interval_brackets_the_mean(sample):
    mean, (lo, hi) = bootstrap.mean_interval(sample.filter("grp = 'big'"), "x", 1_000)
    assert lo < mean < hi
    x = np.array([r.x for r in sample.filter("grp = 'big'").collect()])
    half = 1.96 * x.std() / np.sqrt(len(x))
    assert hi - lo == pytest.approx(2 * half, rel=0.15)


def test_constant_values_have_no_width(spark):
    df = spark.range(30).select(F.col("id").alias("k"), F.lit(2.0).alias("x"))
    assert bootstrap.mean_interval(df, "x", 100) == (2.0, (2.0, 2.0))


def test_empty_column_is_an_error(sample):
    with pytest.raises(ValueError):
        bootstrap.mean_interval(sample.filter("x IS NULL"), "x", 10)


def test_rank_positions_truncate():
    assert (bootstrap.rank_index(2.5, 10_000), bootstrap.rank_index(97.5, 10_000)) == (250, 9750)
    assert (bootstrap.rank_index(2.5, 99), bootstrap.rank_index(97.5, 99)) == (2, 96)


def test_percentiles_pick_sorted_means_without_interpolation(spark):
    df = spark.createDataFrame([("g", float(v)) for v in range(200)], "g string, mean double").repartition(5)
    [r] = rows(bootstrap.percentile_interval(df, ["g"], 200), "g")
    assert (r["ci_lo"], r["ci_hi"]) == (5.0, 195.0)


def test_poisson_weights_average_one(sample):
    out = bootstrap.poisson_means(sample.filter("grp = 'big'"), ["x"], ["accession", "txn_sk"], ["grp"], 400)
    reps = np.array([r.mean_x for r in out.collect()])
    x = np.array([r.x for r in sample.filter("grp = 'big'").collect()])
    assert len(reps) == 400
    assert reps.mean() == pytest.approx(x.mean(), rel=0.01)
    assert reps.std() == pytest.approx(x.std() / np.sqrt(len(x)), rel=0.15)


def panel(spark, values):
    return spark.createDataFrame(
        [(f"a{i}", 1, v, None) for i, v in enumerate(values)],
        "accession string, txn_sk int, abn_1d double, abn_1w double",
    )


@pytest.mark.parametrize("make", [curves.horizon_curve, curves.poisson_curve])
def test_empty_horizons_stay_in_the_curve(spark, make):
    curve = make(panel(spark, [0.1, 0.2, 0.3, None]), ["1d", "1w"], n_boot=40)
    one, week = rows(curves.with_verdicts(curve), "horizon")
    assert (one["n"], one["verdict"]) == (3, "positive") and one["mean_abn"] == pytest.approx(0.2)
    assert (week["n"], week["mean_abn"], week["ci_lo"], week["verdict"]) == (0, None, None, "no data")


def test_verdicts_and_gate(spark):
    curve = spark.createDataFrame(
        [("a", 5, 0.1, 0.05, 0.2), ("b", 5, -0.1, -0.2, -0.05), ("c", 5, 0.0, -0.1, 0.1), ("d", 0, None, None, None)],
        "horizon string, n long, mean_abn double, ci_lo double, ci_hi double",
    )
    assert [r["verdict"] for r in rows(curves.with_verdicts(curve), "horizon")] == [
        "positive", "negative", "includes 0", "no data",
    ]
    assert curves.gate(curve).first().decision == "continue"
    assert curves.gate(curve.filter("horizon <> 'a'")).first().decision == "stop"
    assert curves.gate(curve.filter("false")).first().decision == "stop"


def test_null_and_empty_groups_stay_apart(spark):
    df = spark.createDataFrame(
        [(g, i, v) for g, v in ((None, 1.0), ("", 2.0), ("x", 3.0)) for i in range(5)], "g string, k int, x double"
    )
    means = bootstrap.resampled_means(df, "x", ["g"], 20)
    got = {r.g: (r.n, r.lo, r.hi) for r in means.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.min("mean").alias("lo"), F.max("mean").alias("hi")).collect()}
    assert got == {None: (20, 1.0, 1.0), "": (20, 2.0, 2.0), "x": (20, 3.0, 3.0)}


def bucketed(df, n_boot=800, **options):
    out = bootstrap.bucketed_means(df, "x", ["grp"], n_boot, **options)
    return {(r.grp, r.replicate): r.mean for r in out.collect()}


def test_bucketed_weights_do_not_depend_on_partitions(spark, sample):
    one = bucketed(sample.repartition(4), bucket_values=300)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        two = bucketed(sample.repartition(7), bucket_values=300)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert one.keys() == two.keys() and len(one) == 2 * 800
    assert all(one[k] == pytest.approx(two[k], abs=1e-12) for k in one)
    assert bucketed(sample, seed=9, bucket_values=300) != one


@pytest.mark.parametrize("copies", [1, 50])
def test_bucketed_means_spread_like_the_sampling_distribution(sample, copies):
    """Folded copies weigh what rows of their own would."""
    rows = sample.filter("grp = 'big'").crossJoin(sample.sparkSession.range(copies)) if copies > 1 else sample.filter("grp = 'big'")
    got = np.array(list(bucketed(rows, 2_000, bucket_values=500).values()))
    x = np.array([r.x for r in sample.filter("grp = 'big'").collect()])
    se = x.std() / np.sqrt(len(x) * copies)
    assert got.mean() == pytest.approx(x.mean(), abs=5 * se / np.sqrt(len(got)))
    assert got.std() == pytest.approx(se, rel=0.1)


def test_little_bootstraps_use_few_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.exponential(1.0, 40_000)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)] + [("few", -1, 2.0), ("few", -2, 4.0), ("none", 0, None)], "grp string, k long, x double")
    out = {r.grp: r for r in bootstrap.little_intervals(df.repartition(5), "x", ["k"], ["grp"], n_boot=300, subsets=8, least=500).collect()}
    again = {r.grp: r for r in bootstrap.little_intervals(df.coalesce(1), "x", ["k"], ["grp"], n_boot=300, subsets=8, least=500).collect()}
    assert set(out) == {"g", "few"} and all(out[g].ci_lo == pytest.approx(again[g].ci_lo, abs=1e-12) for g in out)
    g, half = out["g"], 1.96 * x.std() / np.sqrt(len(x))
    assert (g.n, g.subsets) == (40_000, 8) and 0.8 * 8 * 577 < g.rows < 1.2 * 8 * 577  # 40,000^0.6 = 577
    assert (g.ci_hi - g.ci_lo) / 2 == pytest.approx(half, rel=0.15)
    assert (out["few"].n, out["few"].rows, out["few"].subsets) == (2, 2, 1) and 2.0 <= out["few"].ci_lo <= out["few"].ci_hi <= 4.0


def test_ranks_are_among_the_means_there_are(spark):
    means = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", float(i)) for i in range(40)], "g string, mean double")
    got = {r.g: (r.ci_lo, r.ci_hi) for r in bootstrap.percentile_interval(means, ["g"], 100).collect()}
    assert got == {"a": (2.0, 97.0), "b": (1.0, 39.0)}


def test_a_row_is_never_multiplied_by_its_draws(spark):
    """One md5 a key and number, as SQL would draw; nulls, infinite values and groups without a key part keep their sums."""
    data = [(None if k == 3 else f"A{k % 4}", k, g, None if k % 5 == 0 else float("inf") if (k, g) == (7, "n") else k / 3, None if g == "m" else 1.0) for k in range(30) for g in ("m", "n", None)]
    df = spark.createDataFrame(data, "accession string, txn_sk long, grp string, x double, y double")
    out = bootstrap.poisson_means(df, ["x", "y"], ["accession", "txn_sk"], ["grp"], 10)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    sums: dict = {}
    for a, k, g, x, y in data:
        for q in range(3):
            digest = hashlib.md5("|".join([*([a] if a is not None else []), str(k), str(q)]).encode()).hexdigest()
            for slot in range(4):
                w = sum(int(digest[8 * slot : 8 * slot + 8], 16) >= step for step in bootstrap.POISSON_STEPS)
                if q * 4 + slot < 10 and w:
                    cell = sums.setdefault((g, q * 4 + slot), [0.0, 0, 0.0, 0])
                    for at, v in ((0, x), (2, y)):
                        if v is not None:
                            cell[at], cell[at + 1] = cell[at] + w * v, cell[at + 1] + w
    got = {(r.grp, r.replicate): (r.mean_x, r.mean_y) for r in out.collect()}
    assert got.keys() == sums.keys()
    for at, (tx, wx, ty, wy) in sums.items():
        assert got[at][0] == pytest.approx(tx / wx) and got[at][1] == (ty / wy if wy else None)
