"""Quotation linking: messages, their nested quotes, and the conversations they form.

A line's quote level is the number of ">" it starts with. Runs of quoted lines are normalised and hashed: with the quotes inside
them, with what they in turn reply to, alone, and by paragraph. The hashes meet those of all messages' own texts in one ordered join, which finds what a
message replies to: of the messages before it whose own text its quote repeats most specifically, the nearest one. So the same opening in many conversations
is told apart by its place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import splittable_join
from tidemark.session import materialize

BUCKET_ROWS = 20_000
EMPTY = "\x00"  # stands for a text without a word, which can be quoted too
_MARKS = re.compile(r"^(?:[ \t]*>)+[ \t]?")
_INTRODUCES = re.compile(r"(wrote|writes|schrieb|écrit|escribió)\s*:\s*$", re.IGNORECASE)


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, line without its marks) of each line."""
    out = []
    for line in text.splitlines():
        marks = _MARKS.match(line)
        out.append((marks[0].count(">"), line[marks.end() :]) if marks else (0, line))
    return out


def normal(lines: list[str]) -> str:
    return " ".join(" ".join(lines).lower().split())


def _key(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _passage(lines: list[str]) -> str:
    return normal(lines) or EMPTY


def _in_context(lines: list[str], replied_to: list[str]) -> str:
    """A passage together with the passage it replies to, which may be none."""
    return f"{_passage(lines)}\n{normal(replied_to)}"


def paragraphs(lines: list[str]) -> list[str]:
    out, run = [], []
    for line in [*lines, ""]:
        if line.strip():
            run.append(line)
        elif run:
            out.append(normal(run))
            run = []
    return out


def _remarked(lines: list[tuple[int, str]]) -> list[str]:
    return [f"{'>' * level} {line}" if level else line for level, line in lines]


def parse(text: str) -> tuple[str, list[str], list[str]]:
    """(body without quotes, keys of the message's own text, keys of what it quotes); keys go from the most to the least specific.

    A line that announces a quote right before it is not part of the body.
    """
    lines = levels(text)
    body, runs, run = [], [], []
    for i, (level, line) in enumerate(lines):
        if level:
            run.append((level - 1, line))
            continue
        if run and not line.strip():
            continue  # a blank line doesn't end a quote
        if run:
            runs.append(run)
            run = []
        announces = _INTRODUCES.search(line) and any(n for n, _ in lines[i + 1 : i + 2])
        body.append("" if announces else line)
    if run:
        runs.append(run)
    first = [line for level, line in runs[0] if not level] if runs else []
    own = [normal(_remarked([x for x in lines if x[1].strip()])), _in_context(body, first), _passage(body), *paragraphs(body)]
    quoted = []
    for run in runs:
        inner, deeper = ([line for level, line in run if level == depth] for depth in (0, 1))
        quoted += [normal(_remarked([x for x in run if x[1].strip()])), _in_context(inner, deeper), _passage(inner), *paragraphs(inner)]
    keys = lambda texts: [_key(t) for t in dict.fromkeys(t for t in texts if t)]
    return "\n".join(body).strip(), keys(own), keys(quoted)


def _parser(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [parse(t) for t in batch["text"]]
        yield pd.DataFrame({"message_id": batch["message_id"], "body": [m[0] for m in made], "own": [m[1] for m in made], "quoted": [m[2] for m in made]})


def nearest_earlier(quotes: DataFrame, originals: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """message_id, place, original: for each of `quotes` (message_id, place, key) the largest message_id below its own among `originals` (message_id, key).

    Both are ordered by (key, message_id) into ranges of about `bucket_rows`. Inside a range the latest original so far is carried along; a key that runs over
    several ranges, however many rows have it, takes over the latest of the ranges before, of which one row each is compared.
    """
    # At an equal id the quote comes first: nothing replies to itself.
    both = quotes.select("key", "message_id", "place").unionByName(originals.select("key", "message_id", F.lit(-1).alias("place")))
    ranges = quotes.count() // bucket_rows + 1
    dealt = materialize(both.repartitionByRange(ranges, "key", "message_id").withColumn("part", F.spark_partition_id()))
    original = F.when(F.col("place") < 0, F.col("message_id"))
    so_far = Window.partitionBy("part", "key").orderBy("message_id", F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumn("original", F.last(original, ignorenulls=True).over(so_far)).filter("place >= 0")
    latest = dealt.groupBy("key", "part").agg(F.max(original).alias("latest"))
    parts = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.withColumn("carried", F.last("latest", ignorenulls=True).over(parts)).filter("carried IS NOT NULL")
    ours = F.concat_ws(":", "part", "key")
    met = splittable_join(inside.withColumn("spot", ours), carried.select(ours.alias("spot"), "carried"), "spot", "left")
    return met.select("message_id", "place", F.coalesce("original", "carried").alias("original")).filter("original IS NOT NULL")


def conversations(messages: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """message_id, conversation_id, parent_id, depth, body for every row of `messages` (message_id, text).

    Ids are numbers or texts whose order is that of time. A message replies to the nearest message before it (the largest smaller id) whose own text its first
    recognised quote repeats, the more specific way of comparing before the less; no circle can form. An empty text is a text like others: quote marks without a word
    refer to the nearest empty message before. A message
    without a recognised quote starts a conversation of its own. (conversation_id, depth, message_id) is the reply order. Rows without an id are left out, as nothing can
    refer to them; null texts are empty; of rows that repeat an id the smallest text counts. Other columns are not read; an empty table gives no rows.
    """
    kind = messages.schema["message_id"].dataType.simpleString()
    whole = messages.filter("message_id IS NOT NULL").groupBy("message_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    parsed = materialize(whole.mapInPandas(_parser, f"message_id {kind}, body string, own array<string>, quoted array<string>"))
    originals = parsed.select("message_id", F.explode("own").alias("key"))
    quotes = parsed.select("message_id", F.posexplode("quoted").alias("place", "key"))
    met = nearest_earlier(quotes, originals, bucket_rows)
    parents = met.groupBy("message_id").agg(F.min(F.struct("place", "original")).alias("best")).select("message_id", F.col("best.original").alias("parent_id"))
    linked = materialize(parsed.select("message_id").join(parents, "message_id", "left"))
    depth = lambda n: F.lit(n).cast("long").alias("depth")
    settled = linked.filter("parent_id IS NULL").select("message_id", F.col("message_id").alias("top"), depth(0))
    climbing = linked.filter("parent_id IS NOT NULL").select("message_id", F.col("parent_id").alias("top"), depth(1))
    while True:
        # Each round doubles how far up a message sees; those that see their first message are stored once, and only looked up from then on.
        far = lambda rows, there: rows.select(
            F.xxhash64("message_id").alias("key"), F.col("message_id").alias("at"), F.col("top").alias("higher"), F.col("depth").alias("more"), F.lit(there).alias("there")
        )
        above = far(settled, True).unionByName(far(climbing, False))
        met = climbing.withColumn("key", F.xxhash64("top")).join(above, "key").filter("at = top")
        climbed = materialize(met.select("message_id", F.col("higher").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), "there"))
        settled = settled.unionByName(climbed.filter("there").drop("there"))
        climbing = climbed.filter("NOT there").drop("there")
        if climbing.isEmpty():
            break
    found = settled.withColumnRenamed("top", "conversation_id").join(linked, "message_id").join(parsed.select("message_id", "body"), "message_id")
    return found.select("message_id", "conversation_id", "parent_id", "depth", "body")


def _later_texts(turns: DataFrame, repeated: DataFrame, bucket_rows: int) -> DataFrame:
    """conv_id, turn, text, copy: the texts of `repeated` turns (conv_id, turn, first) but the first, numbered from 1. However many
    texts a turn has, they are counted in buckets of about `bucket_rows`."""
    name = F.concat_ws(":", "conv_id", "turn")
    met = splittable_join(turns.withColumn("key", name), repeated.select(name.alias("key"), "first"), "key").filter("text <> first")
    rows = materialize(met.select("conv_id", "turn", "text").distinct())
    bits = max(1, (rows.count() // bucket_rows).bit_length())
    bucketed = rows.withColumn("deal", F.xxhash64("text")).withColumn("bucket", F.shiftrightunsigned("deal", 64 - bits))
    totals = bucketed.groupBy("conv_id", "turn", "bucket").agg(F.count("*").alias("total"))
    before = F.sum("total").over(Window.partitionBy("conv_id", "turn").orderBy("bucket")) - F.col("total")
    inside = F.row_number().over(Window.partitionBy("conv_id", "turn", "bucket").orderBy("deal", "text"))
    placed = bucketed.withColumn("inside", inside).join(totals.withColumn("base", before), ["conv_id", "turn", "bucket"])
    return materialize(placed.select("conv_id", "turn", "text", (F.col("base") + F.col("inside")).cast("long").alias("copy")))


_SIGN = -(1 << 63)


def mail_id(conv_id: Column, turn: Column, copy: Column) -> Column:
    """One text for the three numbers, in their order: 16 hexadecimal digits each, negative ones below the others."""
    digits = lambda c: F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(_SIGN))), 16, "0")
    return F.concat(digits(conv_id), digits(turn), digits(copy))


def mail_numbers(message_id: Column) -> list[Column]:
    """conv_id, turn and copy of a `mail_id`."""
    return [F.conv(F.substring(message_id, 1 + 16 * k, 16), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN)) for k in range(3)]


def as_mail(turns: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """message_id, text: each turn of `conversations` (conv_id, turn, text) as a reply that quotes the turn before it, and that one's quote of the one before.

    message_id is `mail_id` of (conv_id, turn, copy), whatever these numbers are. Rows that repeat conv_id, turn and text are one message. Different texts of one turn
    are messages of their own: copy 0 is the smallest, which is what the turns after it quote. Null texts are empty. Rows without conv_id or turn
    are left out, as they have no place in a conversation. Other columns are not read; an empty table gives no rows.
    """
    told = turns.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text")
    )
    own = materialize(told.groupBy("conv_id", "turn").agg(F.min("text").alias("text"), (F.min("text") < F.max("text")).alias("more")))
    first = own.select("conv_id", "turn", "text")
    rows = first.withColumn("copy", F.lit(0).cast("long"))
    rows = rows.unionByName(_later_texts(told, own.filter("more").withColumnRenamed("text", "first"), bucket_rows))
    quote = lambda c: F.array_join(F.transform(F.split(c, "\n"), lambda line: F.concat(F.lit("> "), line)), "\n")
    back = lambda n: first.select("conv_id", F.try_add("turn", F.lit(n).cast("long")).alias("turn"), F.col("text").alias(f"back{n}"))
    name = F.concat_ws(":", "conv_id", "turn")  # a turn may have any number of texts
    earlier = back(1).join(back(2), ["conv_id", "turn"], "left").select(name.alias("key"), "back1", "back2")
    rows = splittable_join(rows.withColumn("key", name), earlier, "key", "left")
    inner = F.when(F.col("back2").isNull(), F.col("back1")).otherwise(F.concat(quote(F.col("back2")), F.lit("\n"), F.col("back1")))
    mail = F.when(F.col("back1").isNull(), F.col("text")).otherwise(F.concat(F.lit("Earlier somebody wrote:\n"), quote(inner), F.lit("\n"), F.col("text")))
    return rows.select(mail_id(F.col("conv_id"), F.col("turn"), F.col("copy")).alias("message_id"), mail.alias("text"))
