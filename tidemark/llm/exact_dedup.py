"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Blocks are the input's own partitions. Each sends the sorted distinct fingerprints of its rows to their owners, as Golomb-Rice coded gaps, with a mark
on those it has more than once. An owner answers each block with a bitmap: which of these does another block have, or the block itself twice?
The fingerprints behind a set bit, of all blocks, are the shared ones. Rows with a shared fingerprint are suspects: only their texts are shuffled, and compared byte by
byte. The set of shared fingerprints is a few bytes per group of copies and is broadcast up to a stated number; beyond it rows meet it in an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import splittable_join
from tidemark.session import materialize

FINGERPRINT_BITS = 48
OWNER_ROWS = 500_000
MOST_BROADCAST = 2_000_000  # numbers of 64 bits, some 80 MB as a join table


def normalised(text):
    """The compared form: null as empty, A-Z in lower case, all else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """(Rice parameter, code) of sorted distinct non-negative integers: of each gap the quotient in unary, then, after those of all, the rests in binary."""
    if not len(values):
        return 0, b""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    rice = max(0, int(np.log2(max(1.0, float(gaps.mean())))))
    ends = np.cumsum((gaps >> rice) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    rests = (gaps[:, None] >> np.arange(rice - 1, -1, -1)) & 1
    return rice, np.packbits(unary).tobytes() + np.packbits(rests.astype(np.uint8).ravel()).tobytes()


def golomb_decode(rice: int, code: bytes, count: int) -> np.ndarray:
    """The integers behind `golomb_encode`."""
    if not count:
        return np.empty(0, np.int64)
    rest_bytes = -(-count * rice // 8)
    split = len(code) - rest_bytes
    marks = np.flatnonzero(np.unpackbits(np.frombuffer(code[:split], np.uint8)))
    gaps = (np.diff(marks, prepend=-1) - 1).astype(np.int64) << rice
    if rice:
        rests = np.unpackbits(np.frombuffer(code[split:], np.uint8), count=count * rice).reshape(count, rice)
        gaps |= rests.astype(np.int64) @ (np.int64(1) << np.arange(rice - 1, -1, -1, dtype=np.int64))
    return np.cumsum(gaps + 1) - 1


def _width(owners: int) -> int:
    return -(-(1 << FINGERPRINT_BITS) // owners)


def _sender(owners: int):
    """The fingerprints of a block (all rows of a task) -> one coded message for each owner."""
    width = _width(owners)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        every = [b["print"].to_numpy() for b in batches]
        prints, times = np.unique(np.concatenate([np.empty(0, np.int64), *every]), return_counts=True)
        owner, block, out = prints // width, TaskContext.get().partitionId(), []
        for who in np.unique(owner):
            own = owner == who
            rice, code = golomb_encode(prints[own] - who * width)
            out.append((int(who), block, int(own.sum()), rice, code, np.packbits(times[own] > 1).tobytes()))
        yield pd.DataFrame(out, columns=["owner", "block", "count", "rice", "code", "repeated"])

    return send


def _bits(packed: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=count).astype(bool)


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    """All messages to an owner -> for each a bitmap of the fingerprints that are not alone."""
    lists = [golomb_decode(r, c, n) for r, c, n in zip(messages["rice"], messages["code"], messages["count"], strict=True)]
    repeated = np.concatenate([_bits(b, n) for b, n in zip(messages["repeated"], messages["count"], strict=True)])
    _, place, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared, out, at = (times[place] > 1) | repeated, [], 0
    for prints in lists:
        out.append(np.packbits(shared[at : at + len(prints)]).tobytes())
        at += len(prints)
    return messages[["block", "owner"]].assign(bitmap=out)


def _told(owners: int):
    """What a block sent, and the answer -> its shared fingerprints."""
    width = _width(owners)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                golomb_decode(r, c, n)[_bits(b, n)] + who * width
                for who, n, r, c, b in zip(batch["owner"], batch["count"], batch["rice"], batch["code"], batch["bitmap"], strict=True)
            ]
            yield pd.DataFrame({"print": np.concatenate([np.empty(0, np.int64), *found])})

    return told


def _shared_prints(keyed: DataFrame, owners: int) -> DataFrame:
    """(print) of every fingerprint that more than one row has."""
    schema = "owner long, block long, count long, rice int, code binary, repeated binary"
    messages = materialize(keyed.select("print").mapInPandas(_sender(owners), schema))
    answers = messages.groupBy("owner").applyInPandas(_answer, "block long, owner long, bitmap binary")
    return materialize(messages.join(answers, ["block", "owner"]).mapInPandas(_told(owners), "print long").distinct())


def _meet(rows: DataFrame, numbers: DataFrame, column: str, how: str, most: int) -> DataFrame:
    """`rows` joined with the distinct stored `numbers` by a column: broadcast if there are few enough, else exchanged so that a hot one may be split."""
    if numbers.count() <= most:
        return rows.join(F.broadcast(numbers), column, how)
    text = F.col(column).cast("string").alias("met_by")
    keyed = numbers.select(text, *[c for c in numbers.columns if c != column])
    return splittable_join(rows.withColumn("met_by", F.col(column).cast("string")), keyed, "met_by", how).drop("met_by")


def _decided(docs: DataFrame, owner_rows: int, most: int) -> DataFrame:
    """One row per row of `docs`: id, no_id, digest, keep_id, size, kept."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), normalised(F.col("text")).alias("norm"))
    keyed = keyed.withColumn("print", F.shiftrightunsigned(F.xxhash64("norm"), 64 - FINGERPRINT_BITS))
    shared = _shared_prints(keyed, docs.count() // owner_rows + 1)

    digest = F.sha2("norm", 256).alias("digest")
    facts = keyed.select("id", digest, "print")
    facts = _meet(facts, shared.withColumn("suspect", F.lit(True)), "print", "left", most)
    facts = materialize(
        facts.select(
            F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("no_id"), "digest",
            F.coalesce("suspect", F.lit(False)).alias("suspect"), F.monotonically_increasing_id().alias("row"),
        )
    )
    suspects = facts.filter("suspect")
    # The bytes themselves are the grouping key; equal texts combine before the shuffle.
    texts = _meet(keyed, shared, "print", "left_semi", most).select(digest, "norm").groupBy("digest", "norm").agg(F.lit(1).alias("one"))
    if not texts.groupBy("digest").count().filter("count > 1").isEmpty():
        raise ValueError("two different texts share one SHA-256 digest")
    best = F.max(F.struct((~F.col("no_id")).alias("has_id"), F.col("id"), (-F.col("row")).alias("back")))
    classes = materialize(suspects.groupBy("digest").agg(best.alias("best"), F.count("*").alias("size")))
    met = splittable_join(suspects, classes, "digest")
    own = F.when(~F.col("no_id"), F.col("id"))
    grouped = met.select(
        "id", "no_id", "digest", F.when(F.col("best.has_id"), F.col("best.id")).alias("keep_id"), "size", (F.col("row") == -F.col("best.back")).alias("kept")
    )
    alone = facts.filter("NOT suspect").select("id", "no_id", "digest", own.alias("keep_id"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"))
    return alone.unionByName(grouped)


def duplicates(docs: DataFrame, owner_rows: int = OWNER_ROWS, most: int = MOST_BROADCAST) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the
    largest doc_id of equal texts is kept; null ids come last, and a group of null ids only keeps one.
    Rows that repeat id and text all count in group_size, and one of them is kept. An empty table gives
    no rows. Other columns of `docs` are not read.
    """
    own = F.when(~F.col("no_id"), F.col("id"))
    return _decided(docs, owner_rows, most).select(
        own.alias("doc_id"), "keep_id", F.col("size").alias("group_size"), "kept", F.col("digest").alias("text_sha256")
    )


def row_key(doc_id: Column, digest: Column) -> Column:
    """Id and digest of a row in one text; null ids too."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), digest)


def drop_duplicates(docs: DataFrame, owner_rows: int = OWNER_ROWS, most: int = MOST_BROADCAST) -> DataFrame:
    """The rows of `docs` that `duplicates` keeps, with all their columns."""
    found = materialize(_decided(docs, owner_rows, most))
    key = row_key(F.when(~F.col("no_id"), F.col("id")), F.col("digest")).alias("key")
    marks = found.filter("size > 1").groupBy(key).agg(F.bool_or("kept").alias("once"), F.bool_or(~F.col("kept")).alias("dropped"))
    return leave_out(docs, marks.filter("dropped").select("key", "once"), most)


def leave_out(docs: DataFrame, marks: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """`docs` without the rows whose `row_key` is in `marks` (key, once); of those with `once` set, one row of each key stays.

    Rows are first looked up by a hash of their key, so that only those that may be marked meet the marks in an exchange, and all others stay
    where they are. Beyond `most` marks all rows meet them.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    keyed = docs.select(row_key(F.col("doc_id"), F.sha2(normalised(F.col("text")), 256)).alias("key"), row)
    marks = materialize(marks)

    def judged(rows: DataFrame) -> DataFrame:
        stay = splittable_join(rows, marks.select("key"), "key", "left_anti").select("row")
        once = splittable_join(rows, marks.filter("once").select("key"), "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
        return stay.unionByName(once.select("row"))

    hashes = materialize(marks.select(F.xxhash64("key").alias("hash")).distinct())
    if hashes.count() > most:
        return judged(keyed).select("row.*")
    hashed, near = keyed.withColumn("hash", F.xxhash64("key")), F.broadcast(hashes)
    rest = hashed.join(near, "hash", "left_anti").select("row")
    return rest.unionByName(judged(hashed.join(near, "hash", "left_semi").drop("hash"))).select("row.*")
