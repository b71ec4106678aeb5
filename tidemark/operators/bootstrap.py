"""Bootstrap confidence intervals of a mean, distributed over rows and replicates.

``resampled_means`` draws the exact multinomial bootstrap without ever holding a whole group in
one place. A group's rows are first folded to distinct values with weights, so that the work is
bounded by the values there are and not by how often each occurs: an abnormal return belongs to a
ticker and a session, whatever number of events enter there. The values are spread over hash chunks
of bounded size. Each replicate first splits its N draws over the chunks (one multinomial draw over the
chunk weights), then every chunk draws its own share with replacement. The two steps together are N draws
with replacement from the whole group. Seeds depend on (seed, group, chunk, replicate block) only, so the
result does not depend on how Spark places the work.

``poisson_means`` replaces resampling by independent Poisson(1) weights taken from an md5 of the
row key, so that SQL can draw the same ones, and adds them up within each task. ``bucketed_means`` draws such weights in numpy, bucket by
bucket, and adds them up; ``little_intervals`` bootstraps small subsets at the whole group's size.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.joins import splittable_join
from tidemark.session import materialize

CHUNK_VALUES = 1 << 17
# Up to this many rows per distinct value, drawing row by row is quicker than drawing counts.
ROWS_PER_VALUE = 8
BLOCK_REPLICATES = 250


def rank_index(percent: float, n_boot: int) -> int:
    """Position of a percentile in the sorted replicate means, without interpolation."""
    return int(percent / 100 * n_boot)


def _group_text(by: Sequence[str]) -> Column:
    """One text per group, null and empty kept apart."""
    return F.to_json(F.struct(*by))


def _seed(seed: int, group: str, *parts: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(group.encode()), *parts])


def _split_draws(seed: int, n_boot: int):
    """Per (group, block): how many of each replicate's draws fall into each chunk."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for group, chunks, sizes, block in zip(
                frame["boot_group"], frame["chunks"], frame["sizes"], frame["block"]
            ):
                sizes = np.asarray(sizes, dtype=np.int64)
                total = int(sizes.sum())
                reps = min(BLOCK_REPLICATES, n_boot - block * BLOCK_REPLICATES)
                rng = _seed(seed, group, 0, block)
                draws = rng.multinomial(total, sizes / total, size=reps)
                yield pd.DataFrame(
                    {
                        "boot_group": group,
                        "chunk": np.asarray(chunks, dtype=np.int64),
                        "block": np.int64(block),
                        "draws": list(draws.T.astype(np.int64)),
                    }
                )

    return split


def _draw_sums(seed: int):
    """Per (group, chunk, block): the sum of each replicate's draws from this chunk."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for group, chunk, block, values, weights, draws in zip(
                frame["boot_group"], frame["chunk"], frame["block"], frame["values"], frame["weights"], frame["draws"]
            ):
                values, weights = np.asarray(values, dtype=float), np.asarray(weights, dtype=np.int64)
                rng = _seed(seed, group, 1, chunk, block)
                total = int(weights.sum())
                if total <= ROWS_PER_VALUE * len(values):
                    each = np.repeat(values, weights)
                    sums = [each.take(rng.integers(0, total, k, dtype=np.int32)).sum() for k in draws]
                else:
                    sums = [rng.multinomial(k, weights / total) @ values for k in draws]
                yield pd.DataFrame(
                    {
                        "boot_group": group,
                        "replicate": block * BLOCK_REPLICATES + np.arange(len(sums)),
                        "part": sums,
                    }
                )

    return draw


def resampled_means(
    rows: DataFrame,
    value: str,
    by: Sequence[str],
    n_boot: int = 10_000,
    seed: int = 0,
    chunk_values: int = CHUNK_VALUES,
) -> DataFrame:
    """(by…, replicate, mean): exact multinomial bootstrap means of ``value`` per group.

    The number of chunks follows from the distinct values of the largest group, which are counted over
    the stored fold.
    """
    folded = materialize(
        rows.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("weight"))
        .withColumn("boot_group", _group_text(by))
    )
    most = folded.groupBy("boot_group").count().agg(F.max("count")).first()[0] or 0
    n_chunks = max(1, math.ceil(most / chunk_values))
    blocks = math.ceil(n_boot / BLOCK_REPLICATES)
    # A chunk is packed into bounded arrays; sorting makes them independent of arrival order.
    packed = materialize(
        folded.withColumn("chunk", F.pmod(F.xxhash64("value"), F.lit(n_chunks)).cast("long"))
        .groupBy(*by, "boot_group", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("value", "weight"))).alias("cells"))
        .select(*by, "boot_group", "chunk", F.col("cells.value").alias("values"), F.col("cells.weight").alias("weights"))
    )
    total = F.aggregate("weights", F.lit(0).cast("long"), lambda a, w: a + w)
    sizes = packed.select(*by, "boot_group", "chunk", total.alias("size"))
    splits = (
        sizes.groupBy("boot_group")
        .agg(F.sort_array(F.collect_list(F.struct("chunk", "size"))).alias("parts"))
        .select(
            "boot_group",
            F.col("parts.chunk").alias("chunks"),
            F.col("parts.size").alias("sizes"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        )
        .repartition("boot_group", "block")
        .mapInPandas(
            _split_draws(seed, n_boot),
            "boot_group string, chunk long, block long, draws array<long>",
        )
    )
    # One task of drawing is a chunk and a block of replicates; they are dealt out by both.
    tasks = (
        splits.join(packed.select("boot_group", "chunk", "values", "weights"), ["boot_group", "chunk"])
        .select("boot_group", "chunk", "block", "values", "weights", "draws")
        .repartition("boot_group", "chunk", "block")
    )
    sums = tasks.mapInPandas(_draw_sums(seed), "boot_group string, replicate long, part double")
    totals = sizes.groupBy(*by, "boot_group").agg(F.sum("size").alias("n"))
    return (
        sums.groupBy("boot_group", "replicate")
        .agg(F.sum("part").alias("total"))
        .join(totals, "boot_group")
        .select(*by, "replicate", (F.col("total") / F.col("n")).alias("mean"))
    )


def percentile_interval(
    means: DataFrame, by: Sequence[str], n_boot: int, lo: float = 2.5, hi: float = 97.5
) -> DataFrame:
    """(by…, ci_lo, ci_hi) from at most ``n_boot`` replicate means per group; ranks are among those there are."""
    ranked = means.groupBy(*by).agg(F.sort_array(F.collect_list("mean")).alias("means"))
    rank = lambda percent: F.least(F.lit(rank_index(percent, n_boot)), (F.lit(percent / 100) * F.size("means")).cast("int"))
    return ranked.select(*by, F.get("means", rank(lo)).alias("ci_lo"), F.get("means", rank(hi)).alias("ci_hi"))


# 2^32 times the cumulative Poisson(1) distribution at 0, 1, 2, …
POISSON_STEPS = tuple(
    int(2**32 * math.exp(-1) * sum(1 / math.factorial(k) for k in range(top + 1)))
    for top in range(12)
)


GROUPS_HELD = 256


def _keyed_weights(keys: list[str], n_boot: int) -> np.ndarray:
    """keys x replicates: each key's Poisson weights, from the 32-bit words of md5(key and number of the digest)."""
    tails = [str(q).encode() for q in range(math.ceil(n_boot / 4))]
    heads = [k.encode("utf-8", "surrogatepass") for k in keys]
    words = np.frombuffer(b"".join([hashlib.md5(h + t).digest() for h in heads for t in tails]), ">u4")
    return np.searchsorted(POISSON_STEPS, words, "right").astype(np.uint8).reshape(len(keys), -1)[:, :n_boot]


def _weighted_sums(by: Sequence[str], names: Sequence[str], n_boot: int):
    """Per group: each replicate's weighted sums and weights, added up over the rows of a task; a bounded number of groups is held."""

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for group, totals, weights, drawn in held.values():
            (places,) = np.nonzero(drawn)
            columns = [group.column(c).take(pa.array(np.zeros(len(places), np.int64))) for c in range(len(by))]
            columns += [pa.array(places, pa.int64())]
            for k in range(len(names)):
                columns += [pa.array(totals[places, k]), pa.array(weights[places, k])]
            sums = [x for v in names for x in (f"total_{v}", f"weight_{v}")]
            yield pa.RecordBatch.from_arrays(columns, [*by, "replicate", *sums])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows of one key, such as those of its segments, draw the same weights.
            keys, key_names = pd.factorize(batch.column("boot_key").to_pandas())
            groups, group_names = pd.factorize(batch.column("boot_group").to_pandas())
            weights = _keyed_weights(list(key_names), n_boot)
            known = np.column_stack([~np.asarray(batch.column(f"value_{k}").is_null()) for k in range(len(names))])
            values = np.column_stack([batch.column(f"value_{k}").to_numpy(zero_copy_only=False).astype(float) for k in range(len(names))])
            finite = known & np.isfinite(values)
            for g, name in enumerate(group_names):
                own = np.flatnonzero(groups == g)
                times = weights[keys[own]].astype(float).T
                totals = times @ np.where(finite[own], values[own], 0.0)
                for row, k in np.argwhere(known[own] & ~finite[own]):
                    totals[times[:, row] > 0, k] += values[own[row], k]
                made = (totals, times @ known[own].astype(float), times.sum(axis=1))
                if name not in held:
                    held[name] = (batch.select(list(by)).slice(int(own[0]), 1), *(np.zeros_like(x) for x in made))
                for had, new in zip(held[name][1:], made, strict=True):
                    had += new
            if len(held) > GROUPS_HELD:
                yield from emit(held)
                held = {}
        yield from emit(held)

    return draw


def poisson_means(
    rows: DataFrame, values: Sequence[str], key: Sequence[str], by: Sequence[str], n_boot: int
) -> DataFrame:
    """(by…, replicate, mean_<value>…): Poisson(1) bootstrap of several columns at once.

    One md5 serves four replicates of a key. A row is never multiplied: a batch's weights meet its values in one matrix product per group, and a
    task gives one sum per group and replicate. Rows are dealt out by key first, since each of them stands for ``n_boot`` draws.
    """
    # The empty text at the end puts a bar after the last key, as if the number followed.
    key_text = F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit("")).alias("boot_key")
    group = (_group_text(by) if by else F.lit("")).alias("boot_group")
    columns = [F.col(v).cast("double").alias(f"value_{k}") for k, v in enumerate(values)]
    dealt = rows.repartition(*key).select(*by, group, key_text, *columns)
    fields = [f for c in by for f in dealt.schema.fields if f.name == c]
    fields.append(T.StructField("replicate", T.LongType()))
    fields += [T.StructField(f"{part}_{v}", T.DoubleType()) for v in values for part in ("total", "weight")]
    sums = dealt.mapInArrow(_weighted_sums(list(by), list(values), n_boot), T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
    parts = [F.sum(f"{part}_{v}").alias(f"{part}_{v}") for v in values for part in ("total", "weight")]
    return (
        sums.groupBy(*by, "replicate")
        .agg(*parts)
        .select(
            *by,
            "replicate",
            *[F.when(F.col(f"weight_{v}") > 0, F.col(f"total_{v}") / F.col(f"weight_{v}")).alias(f"mean_{v}") for v in values],
        )
    )


def mean_interval(
    df: DataFrame,
    value: str,
    n_boot: int = 10_000,
    lo: float = 2.5,
    hi: float = 97.5,
    seed: int = 0,
) -> tuple[float, tuple[float, float]]:
    """Mean of a column and its percentile bootstrap interval; an empty column is an error."""
    summary = df.agg(F.count(value).alias("n"), F.avg(F.col(value).cast("double")).alias("mean")).first()
    if not summary["n"]:
        raise ValueError(f"{value} holds no values")
    rows = df.withColumn("all_rows", F.lit("all"))
    means = resampled_means(rows, value, ["all_rows"], n_boot, seed)
    ci = percentile_interval(means, ["all_rows"], n_boot, lo, hi).first()
    return summary["mean"], (ci["ci_lo"], ci["ci_hi"])


BUCKET_VALUES = 1 << 14
DRAWS_AT_ONCE = 1 << 20


def _poisson_sums(seed: int, n_boot: int):
    """Per (group, bucket, block): each replicate's weighted sum and its weight, from this bucket."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for group, chunk, block, values, weights in zip(
                frame["boot_group"], frame["chunk"], frame["block"], frame["values"], frame["weights"]
            ):
                values, weights = np.asarray(values, dtype=float), np.asarray(weights, dtype=float)
                rng = _seed(seed, group, 2, chunk, block)
                reps = min(BLOCK_REPLICATES, n_boot - block * BLOCK_REPLICATES)
                rate = 1.0 if (weights == 1).all() else weights
                step = max(1, DRAWS_AT_ONCE // len(values))
                totals, counts = [], []
                for first in range(0, reps, step):
                    drawn = rng.poisson(rate, (min(step, reps - first), len(values)))
                    totals.append(drawn @ values)
                    counts.append(drawn.sum(axis=1))
                yield pd.DataFrame(
                    {
                        "boot_group": group,
                        "replicate": block * BLOCK_REPLICATES + np.arange(reps),
                        "total": np.concatenate(totals),
                        "drawn": np.concatenate(counts),
                    }
                )

    return draw


def bucketed_means(
    rows: DataFrame,
    value: str,
    by: Sequence[str],
    n_boot: int = 10_000,
    seed: int = 0,
    bucket_values: int = BUCKET_VALUES,
) -> DataFrame:
    """(by…, replicate, mean): Poisson bootstrap means of ``value``, drawn per bucket.

    Rows fold to distinct values with their counts, and these are spread over buckets by their hash. A bucket draws a Poisson weight
    with the count as its rate for every value and replicate (the sum of so many weights of rate one), from seeds of
    (seed, group, bucket, block of replicates), and gives a sum and a weight per replicate. These add up over any number of
    buckets, so no group and no vector has to be in one place, and the result does not depend on how Spark places the work.
    The number of buckets is a power of two that follows from the values of the largest group. A replicate that draws nothing is left out.
    """
    folded = materialize(
        rows.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("weight"))
        .withColumn("boot_group", _group_text(by))
    )
    most = folded.groupBy("boot_group").count().agg(F.max("count")).first()[0] or 0
    buckets = 1 << max(0, math.ceil(most / bucket_values) - 1).bit_length()
    cells = F.sort_array(F.collect_list(F.struct("value", "weight")))
    packed = materialize(
        folded.withColumn("chunk", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("long"))
        .groupBy(*by, "boot_group", "chunk")
        .agg(cells.alias("cells"))
        .select(*by, "boot_group", "chunk", F.col("cells.value").alias("values"), F.col("cells.weight").alias("weights"))
    )
    blocks = F.sequence(F.lit(0).cast("long"), F.lit(math.ceil(n_boot / BLOCK_REPLICATES) - 1).cast("long"))
    tasks = (
        packed.select("boot_group", "chunk", "values", "weights", F.explode(blocks).alias("block"))
        .repartition("boot_group", "chunk", "block")
    )
    sums = tasks.mapInPandas(_poisson_sums(seed, n_boot), "boot_group string, replicate long, total double, drawn long")
    named = packed.select(*by, "boot_group").distinct()
    return (
        sums.groupBy("boot_group", "replicate")
        .agg(F.sum("total").alias("total"), F.sum("drawn").alias("drawn"))
        .filter(F.col("drawn") > 0)
        .join(named, "boot_group")
        .select(*by, "replicate", (F.col("total") / F.col("drawn")).alias("mean"))
    )


SUBSETS = 20
SUBSET_EXPONENT = 0.6
LEAST_SUBSET = 1_000  # what N^0.6 is at a hundred thousand rows; smaller subsets understate heavy tails


def _subset_interval(seed: int, n_boot: int, lo: float, hi: float):
    def interval(subset: pd.DataFrame) -> pd.DataFrame:
        group, number, size = subset["boot_group"].iat[0], int(subset["subset"].iat[0]), int(subset["size"].iat[0])
        values = np.sort(subset["value"].to_numpy(float))
        rng = _seed(seed, group, 3, number)
        each = np.full(len(values), 1.0 / len(values))
        means = np.sort([rng.multinomial(size, each) @ values / size for _ in range(n_boot)])
        return pd.DataFrame(
            {"boot_group": [group], "subset": [number], "rows": [len(values)], "ci_lo": [means[rank_index(lo, n_boot)]], "ci_hi": [means[rank_index(hi, n_boot)]]}
        )

    return interval


def little_intervals(
    rows: DataFrame,
    value: str,
    key: Sequence[str],
    by: Sequence[str],
    n_boot: int = 200,
    subsets: int = SUBSETS,
    exponent: float = SUBSET_EXPONENT,
    least: int = LEAST_SUBSET,
    lo: float = 2.5,
    hi: float = 97.5,
    seed: int = 0,
) -> DataFrame:
    """(by…, n, subsets, rows, ci_lo, ci_hi): the bag of little bootstraps.

    A group of N rows falls into disjoint subsets of about N^exponent rows (``least`` at least) by a hash of the key, and the first ``subsets`` of them are used
    (all, if there are fewer). Each draws N rows with replacement from its own few, as one multinomial draw of weights per replicate, and gives a percentile interval;
    the intervals' ends are averaged. Beyond one scan the work is that of subsets x N^exponent rows, which leave the others in the scan's own stage;
    a task holds one subset. Without values a group has no row.
    """
    valued = rows.filter(F.col(value).isNotNull()).select(
        *by, F.col(value).cast("double").alias("value"), F.xxhash64(F.lit(seed), *key).alias("deal"), _group_text(by).alias("boot_group")
    )
    sizes = valued.groupBy(*by, "boot_group").agg(F.count(F.lit(1)).alias("size"))
    parts = F.greatest(F.lit(1).cast("long"), F.floor(F.col("size") / F.greatest(F.lit(least).cast("long"), F.ceil(F.pow("size", F.lit(exponent))))))
    sizes = materialize(sizes.withColumn("parts", parts))
    dealt = splittable_join(valued.drop(*by), sizes.select("boot_group", "size", "parts"), "boot_group")
    taken = dealt.withColumn("subset", F.pmod("deal", F.col("parts"))).filter(F.col("subset") < subsets)
    found = taken.select("boot_group", "subset", "size", "value").groupBy("boot_group", "subset").applyInPandas(
        _subset_interval(seed, n_boot, lo, hi), "boot_group string, subset long, rows long, ci_lo double, ci_hi double"
    )
    averaged = found.groupBy("boot_group").agg(
        F.count(F.lit(1)).alias("subsets"), F.sum("rows").alias("rows"), F.avg("ci_lo").alias("ci_lo"), F.avg("ci_hi").alias("ci_hi")
    )
    return sizes.join(averaged, "boot_group").select(*by, F.col("size").alias("n"), "subsets", "rows", "ci_lo", "ci_hi")
