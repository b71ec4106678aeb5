"""Best-fit packing of tokenised texts under several capacities at once."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import worker_memory
from tidemark.session import materialize

TOKENS = 4096
END_ID = 1
GROUP_PIECES = 20_000
# Of an ordered table: a few blocks of the mix, so that packing moves no piece further than that.
ORDERED_PIECES = 2_000
RUN_ROWS = 20_000
REMEMBERED = 1_000_000  # words of a generation, in each worker
# Letters from which on lower-casing a text could differ from lower-casing its letters one by one.
FAR_LETTERS = re.compile("[^\x00-\u024f]")
PIECES = 20_000
# Of an ordered table: a few blocks of the mix, so that packing moves no piece further than that.
ORDERED_PIECES = 2_000
RUN_ROWS = 20_000
REMEMBERED = 1_000_000  # words of a generation, in each worker
# Letters from which on lower-casing a text could differ from lower-casing its letters one by one.
FAR_LETTERS = re.compile("[^\x00-\u024f]")
# Blanks to Python alone.
SEPARATORS = re.compile("[\x1c-\x1f]")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long, part string, row long"


class _Places(dict):
    """word -> place. A word of the generation before comes over with its place; one never met gets the next place and is noted as fresh."""

    def __init__(self, before: dict[str, int], size: int):
        super().__init__()
        self.before, self.size = before, size
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self.before.get(word)
        if place is None:
            place, self.size = self.size, self.size + 1
            self.fresh.append(word)
        self[word] = place
        return place


class _Encoder:
    """ids of texts as little-endian bytes; each distinct word is tokenised once while it is remembered.

    Words are remembered in two generations of at most about `limit` words or `max_chars` characters each. When the younger one is full it becomes the older one, and what
    was in that and hasn't been met since is forgotten: so common words stay however many rare ones pass by. What is remembered changes no result.
    """

    def __init__(self, path: str, limit: int = REMEMBERED, max_chars: int = 30_000_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's to share out
        self._tokenizer = Tokenizer.from_file(path)
        self._limit, self._max_chars, self._chars = limit, max_chars, 0
        self._places = _Places({}, 0)
        # The ids of all remembered words one after the other, and where those of each place start.
        self._ids, self._used = np.empty(1 << 16, np.uint32), 0
        self._starts, self._lengths = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, added)) or r"(?!)")

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lowered(self, text: str) -> str:
        """The tokenizer's own next step, where it can be taken for the whole text: one form of a word to remember instead of several."""
        return text if FAR_LETTERS.search(text) else text.lower()

    def _gather(self, places: np.ndarray) -> np.ndarray:
        """The ids of the words at `places`, one after the other."""
        lengths = self._lengths[places]
        before = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        return self._ids[np.repeat(self._starts[places] - before, lengths) + np.arange(total)]

    def _store(self, places: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self._used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.empty_like(self._ids)])
        while self._places.size > len(self._starts):
            self._starts, self._lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self._starts, self._lengths))
        self._ids[self._used : self._used + len(ids)] = ids
        self._starts[places] = self._used + np.cumsum(lengths) - lengths
        self._lengths[places] = lengths
        self._used += len(ids)

    def _learn(self) -> None:
        """Takes up fresh words: a word with one mark at its end is made of both parts."""
        places, marked, plain = self._places, [], []
        for word in places.fresh:  # which grows by the parts that are fresh themselves
            self._chars += len(word)
            if word and word[-1] in ".,!?" and word[:-1].isalpha():
                marked.append((places[word], places[word[:-1]], places[word[-1]]))
            else:
                plain.append(word)
        places.fresh = []
        found = self._whole(plain)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        own = np.fromiter(map(places.__getitem__, plain), np.int64, len(plain))
        self._store(own, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths)
        if marked:
            whole, *parts = np.array(marked, np.int64).T
            both = np.stack(parts, 1).ravel()
            self._store(whole, self._gather(both), self._lengths[both].reshape(-1, 2).sum(1))

    def _forget(self) -> None:
        young = self._places
        kept = np.fromiter(young.values(), np.int64, len(young))
        lengths, ids = self._lengths[kept], self._gather(kept)
        self._places = _Places(dict(zip(young, range(len(young)), strict=True)), len(young))
        self._used, self._chars = 0, 0
        self._store(np.arange(len(kept)), ids, lengths)

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        alone = [self._special.search(t) is not None for t in texts]  # a special token may span a blank
        if len(self._places) > self._limit or self._chars > self._max_chars:
            self._forget()
        # What lies between two ASCII blanks can be tokenised alone; other blanks are the tokenizer's to find, inside a part.
        split = pc.ascii_split_whitespace(pa.array(["" if x else self._lowered(t) for t, x in zip(texts, alone, strict=True)], pa.large_string()))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        places = np.fromiter(map(self._places.__getitem__, distinct), np.int64, len(distinct))
        if self._places.fresh:
            self._learn()
        places = places[words.indices.to_numpy()]
        ids, counts = self._gather(places), np.asarray(split.value_lengths())
        ends = np.concatenate([[0], np.cumsum(self._lengths[places])])[np.concatenate([[0], np.cumsum(counts)])]
        for text, whole, first, last in zip(texts, alone, ends, ends[1:], strict=False):
            yield array("I", self._whole([text])[0]).tobytes() if whole else ids[first:last].tobytes()


def _cutter(path: str, tokens: int, end_id: int, remembered: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        kept = worker_memory("tokens")
        if kept.get("encoder_of") != (path, remembered):
            kept.update(encoder=_Encoder(path, remembered), encoder_of=(path, remembered))
        encode, end = kept["encoder"], array("I", [end_id]).tobytes()
        deal = TaskContext.get().partitionId() * 7919  # groups are dealt from another start in each task
        for batch in batches:
            out = []
            places = zip(batch["id"], batch["no_id"], batch["part"], batch["row"], strict=True)
            for (doc_id, missing, stored, row), ids in zip(places, encode(list(batch["text"])), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * tokens)):
                    part = ids[at : at + 4 * tokens]
                    out.append((None if missing else doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), deal, stored, row))
                    deal += 1
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "deal", "part", "row"])
            yield frame.astype({"doc_id": "Int64"})

    return cut


def token_pieces(
    docs: DataFrame, tokenizer_path: str, tokens: int = TOKENS, end_id: int = END_ID, order: tuple[Column, Column] | None = None, remembered: int = REMEMBERED
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, deal, part, row: the texts of `docs` as token ids, cut where longer than `tokens`.

    A null or empty text has the end id only. Rows that repeat an id each give their pieces. `part` and `row` are those of `order`.
    """
    part, row = order or (F.lit(""), F.lit(0))
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce("text", F.lit("")).alias("text"), part.alias("part"), row.cast("long").alias("row"),
    )
    return texts.mapInPandas(_cutter(tokenizer_path, tokens, end_id, remembered), PIECES)


def vector_best_fit(demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """The bin of each item; `demand` is items x resources, `capacity` and `weights` one number per resource.

    Items go from large to small by their weighted share of the capacities. Of the open bins that fit an item
    under every capacity, "norm" takes the one whose weighted residual is shortest after placing it, "dot" the one whose
    residual points most along the item (largest weighted dot product, residuals taken relative to their length).
    A new bin opens only if none fits. Ties go to the bin opened first.
    """
    shares = demand / capacity
    order = np.argsort(-(shares * weights).max(axis=1), kind="stable")
    floor = shares.min(axis=0)
    tiny = 1e-12
    left, names, opened = np.empty((64, shares.shape[1])), np.empty(64, np.int64), 0
    live = 0
    out = np.empty(len(demand), np.int64)
    for i in order:
        item = shares[i]
        room = left[:live] - item
        fits = np.flatnonzero((room >= -tiny).all(axis=1)) if live else ()
        if len(fits):
            if rule == "dot":
                space = left[fits]
                score = -((space * item) @ weights) / np.sqrt((space * space) @ weights + tiny)
            else:
                score = (room[fits] ** 2) @ weights
            at = fits[np.argmin(score)]
        else:
            if live == len(left):
                left, names = np.concatenate([left, np.empty_like(left)]), np.concatenate([names, np.empty_like(names)])
            at, live = live, live + 1
            left[at], names[at] = 1.0, opened
            opened += 1
        left[at] -= item
        out[i] = names[at]
        if (left[at] < floor - tiny).any():  # nothing fits any more: the last open bin takes its place
            live -= 1
            left[at], names[at] = left[live], names[live]
    return out


def _ranked(pieces: DataFrame, run_rows: int) -> DataFrame:
    """`pieces` with their places in the order (part, row, piece) as `deal`, counted from 0; long parts are counted in runs of `run_rows` rows."""
    runs = pieces.withColumn("run", F.floor(F.col("row") / run_rows).cast("long"))
    totals = runs.groupBy("part", "run").agg(F.count("*").alias("total"))
    before = F.sum("total").over(Window.orderBy("part", "run")) - F.col("total")  # one row for each run
    bases = totals.select(F.col("part").alias("of"), F.col("run").alias("nth"), before.alias("base"))
    inside = F.row_number().over(Window.partitionBy("part", "run").orderBy("row", "piece")) - 1
    placed = runs.withColumn("inside", inside).join(bases, (F.col("part") == F.col("of")) & (F.col("run") == F.col("nth")))
    return placed.withColumn("deal", F.col("base") + F.col("inside"))


def stored_order(docs: DataFrame) -> tuple[Column, Column]:
    """(part, row), by which the rows of `docs` have the order in which they are stored: by number and name of their part files and the
    place in the file, if `docs` is a table just read from Parquet; else the order of its partitions."""
    if docs._jdf.queryExecution().analyzed().children().isEmpty() and docs.inputFiles():
        files = docs.metadataColumn("_metadata")
        name = files["file_name"]
        return F.concat(F.lpad(F.regexp_extract(name, r"part-(\d+)", 1), 20, "0"), name), files["row_index"]
    return F.lpad(F.spark_partition_id().cast("string"), 20, "0"), F.monotonically_increasing_id()


def _packer(capacity: tuple[float, ...], weights: tuple[float, ...], rule: str, in_order: bool = False):
    def pack(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "deal"], ascending=[False, True], ignore_index=True)
        length = pieces["length"].to_numpy(float)
        demand = np.stack([length, np.ones_like(length), length**2], axis=1)
        bins = vector_best_fit(demand, np.array(capacity), np.array(weights), rule)
        if in_order:  # a sequence stands where its first piece stands, whatever pieces fill it up
            _, first = np.unique(bins, return_index=True)
            nth = np.empty(len(first), np.int64)
            nth[np.argsort(pieces["deal"].to_numpy()[first])] = np.arange(len(first))
            bins = nth[bins]
        pieces["sequence_id"] = pieces["bunch"] * (1 << 32) + bins
        pieces["offset"] = pieces.groupby("sequence_id")["length"].cumsum() - pieces["length"]
        return pieces.drop(columns=["bunch", "deal", "no_id"]).assign(doc_id=pieces["doc_id"].where(~pieces["no_id"]).astype("Int64"))

    return pack


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    tokens: int = TOKENS,
    documents: int = TOKENS,
    attention: int = TOKENS * TOKENS,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
    end_id: int = END_ID,
    group_pieces: int = GROUP_PIECES,
    order: tuple[Column, Column] | None = None,
    run_rows: int = RUN_ROWS,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """One row per piece of a text: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A sequence holds at most `tokens` tokens, `documents` pieces, and an attention cost (sum of squared lengths,
    as attention stays within a document) of `attention`. The defaults leave the first one binding, for as few
    sequences as possible. Pieces are stored once and dealt evenly into groups of about `group_pieces`, each packed by
    `vector_best_fit` in one task; a group alone leaves about one sequence unfilled. Whatever the ids or texts repeat,
    groups stay even. With an `order` of the rows (a text and a number, by which they are ordered, such as `stored_order` gives), groups are
    consecutive runs of it, and sequences are numbered by the places of their largest pieces: so the order of sequence_id follows that
    of the rows, to within a group. `remembered` bounds the words a worker remembers. Null ids stay null, null texts are empty, other columns are not read, and an empty table gives no rows.
    """
    if attention < tokens * tokens:
        # A piece alone must fit: cut so that its own cost does.
        tokens_cut = min(tokens, int(attention**0.5))
    else:
        tokens_cut = tokens
    stored = materialize(token_pieces(docs, tokenizer_path, tokens_cut, end_id, order, remembered))
    count = stored.count()
    groups = count // group_pieces + 1
    bunch = F.pmod("deal", F.lit(groups))
    if order:
        stored = _ranked(stored, run_rows)
        bunch = F.floor(F.col("deal") * groups / max(1, count)).cast("long")
    dealt = stored.select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "piece", "start", "length",
        "ids_crc32", "deal", bunch.alias("bunch"),
    )
    packer = _packer((tokens, documents, attention), weights, rule, order is not None)
    return dealt.groupBy("bunch").applyInPandas(
        packer, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
