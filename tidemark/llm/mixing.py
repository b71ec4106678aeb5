"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling of equal blocks.

Each source's rows, in hash order, are cut into blocks of one size. Block i of a source of weight w, of W in all, is released at
slot floor(i W / w) and due at slot ceil((i + 1) W / w); of the released blocks the one due earliest takes the next slot. No
deadline is missed, so at any slot a source is less than one block away from its share. The schedule repeats every W slots;
so only one period is worked out, and each block finds its slot by arithmetic. When a source runs out, the others go
on by their weights in a new phase, so no row is left out and none is repeated.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import normalised
from tidemark.session import materialize

BLOCK_CHARS = 1_000_000
BUCKET_ROWS = 4_000
# The target of the registered query and of the pipeline; other sources have weight 1.
TARGETS = {"src0": 5.0, "src1": 3.0, "src2": 2.0, "src3": 2.0}
RESOLUTION = 10_000
SPAN_BLOCKS = 50_000


@dataclass(frozen=True)
class Turn:
    """Blocks first .. last-1 of a source in one phase: block first + q w + r has slot start + q period + slots[r]."""

    source: str
    first: int
    last: int
    start: int
    period: int
    slots: tuple[int, ...]


def whole_weights(weights: dict[str, float], resolution: int = RESOLUTION) -> dict[str, int]:
    """Integer weights in the same proportions, of which the sum is about `resolution` at most; exact if they are small integers."""
    total = sum(weights.values())
    if all(w > 0 and float(w).is_integer() for w in weights.values()) and total <= resolution:
        shared = math.gcd(*(int(w) for w in weights.values()))
        return {s: int(w) // shared for s, w in weights.items()}
    return {s: max(1, round(w / total * resolution)) for s, w in weights.items()}


def one_period(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period, earliest deadline first among the released blocks; ties go by name."""
    period = sum(weights.values())
    coming = [(0, s, 0) for s in sorted(weights)]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in weights}
    for slot in range(period):
        while coming and coming[0][0] <= slot:
            _, s, i = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(i + 1) * period // weights[s]), s, i))
        _, s, i = heapq.heappop(ready)
        slots[s].append(slot)
        if i + 1 < weights[s]:
            heapq.heappush(coming, ((i + 1) * period // weights[s], s, i + 1))
    return slots


def schedule(blocks: dict[str, int], weights: dict[str, int]) -> list[Turn]:
    """The turns of all sources until the last block; at most as many phases as sources."""
    done, start, turns = dict.fromkeys(blocks, 0), 0, []
    while active := {s: weights[s] for s in blocks if done[s] < blocks[s]}:
        shared = math.gcd(*active.values())
        active = {s: w // shared for s, w in active.items()}
        slots, period = one_period(active), sum(active.values())
        slot_of = lambda s, i: i // active[s] * period + slots[s][i % active[s]]  # noqa: B023, E731
        end = min(slot_of(s, blocks[s] - done[s] - 1) for s in active) + 1
        for s, w in active.items():
            used = end // period * w + sum(x < end % period for x in slots[s])
            if used:
                turns.append(Turn(s, done[s], done[s] + used, start, period, tuple(slots[s])))
            done[s] += used
        start += end
    return turns


def mixed(
    docs: DataFrame, weights: dict[str, float] | None = None, other: float = 1.0, block_chars: int = BLOCK_CHARS, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """doc_id, source, copies, size, block, slot, start, text_sha256: where each row of `docs` (doc_id, text, source) goes in the mix.

    The mix is the order of (slot, start). `weights` names target weights of sources; all others have `other`. `size` counts a
    row's characters, one at least; `block` is the block of its source in which it starts, `start` its place in the source. Rows
    that repeat id, text and source are one row with their number in `copies`, and keep together. A null source is a source of
    its own, named as null in the result. Null ids and texts are rows like others; an empty table gives no rows. A source's rows meet in
    buckets of about `bucket_rows`, however large it is. The driver sees one number per source.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.sha2(normalised(F.col("text")), 256).alias("text_sha256"), F.greatest(F.char_length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long").alias("size"),
    )
    rows = rows.groupBy("doc_id", "source", "text_sha256").agg(F.count("*").alias("copies"), F.sum("size").alias("size"))
    rows = materialize(rows.withColumn("deal", F.xxhash64("doc_id", "text_sha256")))
    bits = max(1, (rows.count() // bucket_rows).bit_length())
    bucketed = rows.withColumn("bucket", F.shiftrightunsigned("deal", 64 - bits))
    totals = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(Window.partitionBy("source").orderBy("bucket")) - F.col("total")
    bases = totals.select(F.col("source").alias("of"), F.col("bucket").alias("part"), before.alias("base"))
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("deal", "doc_id", "text_sha256").rowsBetween(Window.unboundedPreceding, 0))
    laid = bucketed.withColumn("inside", inside - F.col("size")).join(bases, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("part")))
    laid = laid.withColumn("start", F.col("base") + F.col("inside")).withColumn("block", F.floor(F.col("start") / block_chars).cast("long"))
    laid = materialize(laid.select("doc_id", "source", "copies", "size", "block", "start", "text_sha256"))

    # Names are marked, so that a null source stays apart from one named alike.
    named = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    counts = {r["name"]: r["blocks"] for r in laid.groupBy(named.alias("name")).agg((F.max("block") + 1).alias("blocks")).collect()}
    shares = {s: (weights or {}).get(s[1:], other) if s != "n" else other for s in counts}
    turns = schedule(counts, whole_weights(shares)) if counts else []
    plan = spark.createDataFrame(
        [(t.source, t.first, t.last, t.start, t.period, list(t.slots)) for t in turns],
        "name string, first long, last long, begin long, period long, slots array<int>",
    )
    spans = plan.withColumn("low", F.explode(F.sequence("first", F.col("last") - 1, F.lit(SPAN_BLOCKS).cast("long"))))
    blocks = spans.repartition("name", "low").withColumn("at", F.explode(F.sequence("low", F.least(F.col("low") + SPAN_BLOCKS, F.col("last")) - 1)))
    nth, width = F.col("at") - F.col("first"), F.size("slots")
    slot = F.col("begin") + F.floor(nth / width).cast("long") * F.col("period") + F.element_at("slots", (F.pmod(nth, width) + 1).cast("int"))
    placed = laid.withColumn("name", named).withColumnRenamed("block", "at").join(blocks.select("name", "at", slot.alias("slot")), ["name", "at"])
    return placed.select("doc_id", "source", "copies", "size", F.col("at").alias("block"), "slot", "start", "text_sha256")


def mix(docs: DataFrame, **options) -> DataFrame:
    """All rows of `docs` with all their columns, in the order of the mix: sorted within and across partitions, so that
    the part files of a table written from it hold it in their order."""
    order = mixed(docs, **options).groupBy("doc_id", "text_sha256").agg(F.min(F.struct("slot", "start")).alias("at"))
    key = lambda i, d: F.concat(F.coalesce(i.cast("string"), F.lit("-")), F.lit(":"), d)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(key(F.col("doc_id"), F.sha2(normalised(F.col("text")), 256)).alias("key"), row)
    placed = rows.join(order.select(key(F.col("doc_id"), F.col("text_sha256")).alias("key"), "at"), "key")
    return placed.repartitionByRange("at").sortWithinPartitions("at").select("row.*")
