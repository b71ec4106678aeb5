"""Median of everything an insider traded before a day, for every day the insider traded.

Insiders with few trades use a percentile window. That is quadratic in the group, so busier
insiders take another exact route whose steps are all bounded:

1. trades fold to (insider, day, value, weight), so a repeated value costs one row a day, and running weights by
   day give each day's middle ranks;
2. approximate quantiles cut the insider's values into buckets of similar mass; from the weights per (day, bucket) each
   rank is followed into one bucket;
3. a bucket that still has more than ``bucket_rows`` rows is cut again in the same way, in as many
   passes as it takes, and only buckets that some rank fell into go on;
4. inside a bucket small enough the rank is resolved exactly.

Step 2 runs per bucket of the pass before and holds at most days x ``WIDTH`` cells, step 4 at most ``bucket_rows``
rows: so no task grows with the busiest insider, only the number of passes does, with its logarithm.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import splittable_join
from tidemark.session import materialize

WINDOW_ROWS = 1_000
WIDTH = 64  # buckets a pass cuts a bucket into
BUCKET_ROWS = 100_000


def prior_medians(
    events: DataFrame,
    window_rows: int = WINDOW_ROWS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(insider_id, filing_date, prior_median) over trades on strictly earlier days.

    One plan for every table: each insider's trades take the window or the buckets by their number,
    and both are exact.
    """
    rows = events.filter(
        F.col("insider_id").isNotNull() & F.col("filing_date").isNotNull()
    ).select("insider_id", "filing_date", F.col("value").cast("double").alias("value"))
    sizes = rows.groupBy("insider_id").agg(F.count(F.lit(1)).alias("rows"))
    busy = sizes.filter(F.col("rows") > window_rows).select("insider_id")
    calm = sizes.filter(F.col("rows") <= window_rows).select("insider_id")
    few = splittable_join(rows, calm, "insider_id", "left_semi")
    many = splittable_join(rows, busy, "insider_id", "left_semi")
    return _window_medians(few).unionByName(_bucketed_medians(many, bucket_rows))


def _window_medians(rows: DataFrame) -> DataFrame:
    earlier = (
        Window.partitionBy("insider_id")
        .orderBy(F.unix_date("filing_date"))
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    return rows.select(
        "insider_id",
        "filing_date",
        F.percentile("value", 0.5).over(earlier).alias("prior_median"),
    ).distinct()


_ASKED = "insider_id string, path long, day long, side long, rank long"


def _bucketed_medians(rows: DataFrame, bucket_rows: int) -> DataFrame:
    folded = materialize(
        rows.withColumn("day", F.unix_date("filing_date").cast("long"))
        .groupBy("insider_id", "day", "value")
        .agg(F.count("value").alias("weight"))
    )
    # Rows without a value carry weight 0: they ask for a median but add nothing to it.
    days = folded.groupBy("insider_id", "day").agg(F.sum("weight").alias("weight"))
    before = F.sum("weight").over(Window.partitionBy("insider_id").orderBy("day")) - F.col("weight")
    days = materialize(days.withColumn("before", before).drop("weight"))
    sides = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("side")
    asked = days.filter(F.col("before") > 0).select("insider_id", F.lit(0).cast("long").alias("path"), "day", "before", sides)
    asked = asked.withColumn("rank", F.floor((F.col("before") - 1 + F.col("side")) / 2).cast("long")).drop("before")
    items = folded.filter(F.col("weight") > 0).withColumn("path", F.lit(0).cast("long"))

    found = None
    while True:
        group = F.concat_ws(":", "path", "insider_id")
        # What is all one value has a row a day at most, and can't be cut.
        cut = (F.count(F.lit(1)) > bucket_rows) & (F.min("value") < F.max("value"))
        sizes = materialize(items.groupBy("insider_id", "path").agg(cut.alias("cut")).withColumn("bucket", group))
        large, small = sizes.filter("cut").select("bucket"), sizes.filter("NOT cut").select("bucket")
        keyed, wanted = items.withColumn("bucket", group), asked.withColumn("bucket", group)
        pick = lambda side, which: splittable_join(side, which, "bucket", "left_semi").drop("bucket")
        ready = (
            pick(keyed, small).groupBy("insider_id", "path")
            .cogroup(pick(wanted, small).groupBy("insider_id", "path"))
            .applyInPandas(_resolve, "insider_id string, day long, side long, value double")
        )
        found = materialize(ready) if found is None else found.unionByName(materialize(ready))
        if large.isEmpty():
            break
        items, asked = _cut_again(pick(keyed, large), pick(wanted, large))
    medians = found.groupBy("insider_id", "day").agg(F.avg("value").alias("prior_median"))
    return (
        days.select("insider_id", "day")
        .join(medians, ["insider_id", "day"], "left")
        .select("insider_id", F.date_from_unix_date(F.col("day").cast("int")).alias("filing_date"), "prior_median")
    )


def _cut_again(items: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of large buckets in narrower ones, and the ranks asked for as ranks within those."""
    items = materialize(items.withColumn("bucket", F.concat_ws(":", "path", "insider_id")))
    cuts = items.groupBy("bucket").agg(
        F.percentile_approx("value", [i / WIDTH for i in range(1, WIDTH - 1)], 10_000).alias("cuts"),
        # Between the extremes, so that every pass parts what is not all one value.
        (F.min("value") / 2 + F.max("value") / 2).alias("middle"), F.min("value").alias("least"), F.max("value").alias("most"),
    )
    middle = F.when((F.col("middle") >= F.col("least")) & (F.col("middle") < F.col("most")), F.col("middle")).otherwise(F.col("least"))
    cuts = cuts.select("bucket", F.array_append("cuts", middle).alias("cuts"))
    place = F.size(F.filter("cuts", lambda c: c < F.col("value"))).cast("long")
    parted = materialize(
        splittable_join(items, cuts, "bucket")
        .select("insider_id", "path", "day", "value", "weight", (F.col("path") * WIDTH + place).alias("narrower"))
    )
    cells = parted.groupBy("insider_id", "path", "day", "narrower").agg(F.sum("weight").alias("weight"))
    followed = materialize(
        cells.groupBy("insider_id", "path").cogroup(asked.groupBy("insider_id", "path")).applyInPandas(_follow, _ASKED)
    )
    reached = followed.select(F.concat_ws(":", "path", "insider_id").alias("bucket")).distinct()
    kept = parted.select("insider_id", F.col("narrower").alias("path"), "day", "value", "weight")
    kept = splittable_join(kept.withColumn("bucket", F.concat_ws(":", "path", "insider_id")), reached, "bucket", "left_semi")
    return materialize(kept.drop("bucket")), followed


def _follow(cells: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Each asked rank, among the weights of earlier days, as a narrower bucket and the rank within it."""
    if asked.empty or cells.empty:
        return asked.iloc[:0]
    days, row = np.unique(cells["day"].to_numpy(), return_inverse=True)
    names, col = np.unique(cells["narrower"].to_numpy(), return_inverse=True)
    grid = np.zeros((len(days) + 1, len(names)), dtype=np.int64)
    np.add.at(grid, (row + 1, col), cells["weight"].to_numpy())
    upto = grid.cumsum(axis=0).cumsum(axis=1)
    at = np.searchsorted(days, asked["day"].to_numpy(), side="left")
    rank = asked["rank"].to_numpy()
    column = (upto[at] <= rank[:, None]).sum(axis=1)
    below = np.where(column > 0, upto[at, np.maximum(column - 1, 0)], 0)
    return asked.assign(path=names[column], rank=rank - below)


def _resolve(items: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The value at each asked rank among items of earlier days.

    Items are laid out by day and split by the bits of their value's rank, highest bit first;
    every question follows its own rank down, all questions at once.
    """
    if asked.empty:
        days = np.array([], dtype=np.int64)
        ids = np.array([], dtype=object)
        return pd.DataFrame({"insider_id": ids, "day": days, "side": days, "value": days * 1.0})
    items = items.sort_values(["day", "value"])
    values, code = np.unique(items["value"].to_numpy(), return_inverse=True)
    weight = items["weight"].to_numpy().astype(np.int64)
    left = np.zeros(len(asked), dtype=np.int64)
    right = np.searchsorted(items["day"].to_numpy(), asked["day"].to_numpy(), side="left")
    rank = asked["rank"].to_numpy().astype(np.int64)
    answer = np.zeros(len(asked), dtype=np.int64)
    for bit in reversed(range(max(1, int(len(values) - 1).bit_length()))):
        low = ((code >> bit) & 1) == 0
        n_low = np.concatenate([[0], low.cumsum()])
        w_low = np.concatenate([[0], np.where(low, weight, 0).cumsum()])
        mass = w_low[right] - w_low[left]
        up = rank >= mass
        rank = np.where(up, rank - mass, rank)
        answer |= up.astype(np.int64) << bit
        first_high = n_low[-1]
        left, right = (
            np.where(up, first_high + left - n_low[left], n_low[left]),
            np.where(up, first_high + right - n_low[right], n_low[right]),
        )
        order = np.argsort(~low, kind="stable")
        code, weight = code[order], weight[order]
    return pd.DataFrame(
        {
            "insider_id": asked["insider_id"].to_numpy(),
            "day": asked["day"].to_numpy(),
            "side": asked["side"].to_numpy(),
            "value": values[answer],
        }
    )


def with_own_size(events: DataFrame, **limits) -> DataFrame:
    """Trade value against the insider's own prior median."""
    medians = prior_medians(events, **limits)
    return events.join(medians, ["insider_id", "filing_date"], "left").withColumn(
        "value_vs_own", F.try_divide(F.col("value"), F.col("prior_median"))
    )
