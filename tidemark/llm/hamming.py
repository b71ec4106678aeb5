"""Exact top-k search over binary codes by incremental multi-index hashing.

A code, of any width, is cut into m segments. If two codes differ in at most m s + a bits, one of the segments differs in at
most s bits, and counting segments from the first, one of the first a + 1 in at most s or one of the others in at most s - 1. So segment
indexes are searched with growing radii, segment by segment, until as many rows as asked for are verified within the radius
covered so far. Nothing nearer can be left, so the answer is exact. Codes lie in chunks, each with indexes of its own. A query first searches one chunk;
the distance of its kth row there bounds the radii to which it searches all others.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

WORD = 64
CHUNK_CODES = 20_000
BLOCK_QUERIES = 1_000


def sign_code(vector: Column | str, words: int = 1) -> Column:
    """One bit for each of the first 64 x `words` elements, set where it is above zero, as an array of longs; missing, null and NaN elements give 0. Null for a null vector."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    bits = F.transform(vector, lambda x: F.when((x > 0) & ~F.isnan(x), F.expr("1L")).otherwise(F.expr("0L")))

    def word(k: int) -> Column:
        placed = F.transform(F.slice(bits, WORD * k + 1, WORD), lambda b, i: F.call_function("shiftleft", b, i))
        return F.aggregate(placed, F.expr("0L"), lambda a, b: a.bitwiseOR(b))

    return F.when(vector.isNotNull(), F.array(*[word(k) for k in range(words)]))


def segment_bounds(rows: int, words: int = 1) -> list[tuple[int, int, int]]:
    """(word, first bit, width) of each segment: about log2 of the number of codes wide, so that a bucket holds a few codes."""
    count = max(2, min(16, round(WORD / max(4.0, math.log2(max(2, rows))))))
    cuts = [round(k * WORD / count) for k in range(count + 1)]
    return [(w, a, b - a) for w in range(words) for a, b in zip(cuts, cuts[1:], strict=False)]


def _flips(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.uint64)


class SegmentIndex:
    """Codes (rows x words), sorted by each of their segments."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.bounds = codes.astype(np.uint64), segment_bounds(len(codes), codes.shape[1])
        self.bits = WORD * codes.shape[1]
        self.sorted = []
        for word, first, width in self.bounds:
            values = (self.codes[:, word] >> np.uint64(first)) & np.uint64((1 << width) - 1)
            order = np.argsort(values, kind="stable")
            self.sorted.append((values[order], order))
        self._masks: dict[tuple[int, int], np.ndarray] = {}

    def bucket(self, segment: int, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of the codes whose segment differs from that of `code` in exactly `radius` bits."""
        (word, first, width), (values, order) = self.bounds[segment], self.sorted[segment]
        if radius > width:
            return order[:0]
        if (width, radius) not in self._masks:
            self._masks[width, radius] = _flips(width, radius)
        asked = ((code[word] >> np.uint64(first)) & np.uint64((1 << width) - 1)) ^ self._masks[width, radius]
        low, high = np.searchsorted(values, asked, "left"), np.searchsorted(values, asked, "right")
        met = high > low
        low, count = low[met], (high - low)[met]
        if not len(low):
            return order[:0]
        steps = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return order[np.repeat(low, count) + steps]

    def nearest(self, code: np.ndarray, k: int, weight: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of all codes within the radius at which at least k rows are verified; `weight` rows stand behind a code.
        Beyond the distance `limit` nothing is looked for."""
        code, m = np.asarray(code, np.uint64), len(self.bounds)
        limit = self.bits if limit is None else limit
        seen = np.zeros(len(self.codes), bool)
        distance = np.full(len(self.codes), self.bits + 1, np.int64)
        found: list[np.ndarray] = []
        within = np.zeros(self.bits + 1, np.int64)  # rows verified at each distance
        for radius in range(max(w for _, _, w in self.bounds) + 1):
            for segment in range(m):
                new = self.bucket(segment, code, radius)
                new = new[~seen[new]]
                if len(new):
                    seen[new] = True
                    distance[new] = np.bitwise_count(self.codes[new] ^ code).sum(1)
                    within += np.bincount(distance[new], weight[new], self.bits + 1).astype(np.int64)
                    found.append(new)
                covered = min(limit, m * radius + segment)
                if covered == limit or within[: covered + 1].sum() >= k:
                    places = np.concatenate(found) if found else np.empty(0, np.int64)
                    kept = places[distance[places] <= covered]
                    return kept, distance[kept]
        places = np.concatenate(found) if found else np.empty(0, np.int64)
        places = places[distance[places] <= limit]
        return places, distance[places]


def _words(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(c, np.int64) for c in column]).view(np.uint64)


def _searcher(k: int):
    def search(codes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: tuple[list, list, list] = ([], [], [])
        if len(codes) and len(queries):
            index = SegmentIndex(_words(codes["code"]))
            weight = codes["rows"].to_numpy()
            names = codes["number"].to_numpy()
            for query, code, limit in zip(queries["query_id"], _words(queries["code"]), queries["bound"], strict=True):
                # One more than asked for: the query's own row may be among them.
                places, distance = index.nearest(code, k + 1, weight, None if pd.isna(limit) else int(limit))
                order = np.argsort(distance, kind="stable")
                at = distance[order]
                enough = np.searchsorted(np.cumsum(weight[places[order]]), k + 1)
                cut = np.searchsorted(at, at[min(enough, len(at) - 1)], "right") if len(at) else 0  # ties at the last distance stay
                chosen = order[:cut]
                found[0].extend([query] * len(chosen))
                found[1].extend(names[places[chosen]])
                found[2].extend(distance[chosen].tolist())
        return pd.DataFrame(dict(zip(("query_id", "number", "distance"), found, strict=True)), dtype="int64")

    return search


def nearest_codes(
    rows: DataFrame, queries: DataFrame, k: int = 10, chunk_codes: int = CHUNK_CODES, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """query_id, neighbour_id, distance, rank: for each row of `queries` (id, code) its `k` nearest other rows of `rows` (id, code).

    Codes are arrays of longs, all of one length. Distance is the number of differing bits; ties go to the smaller id. Fewer than k other rows give as many as there are. Rows without an id or a code are
    not indexed and not searched for; rows that repeat an id and code count once. However many rows share a code, it is searched once, and the
    smallest k + 1 ids stand for it. Each block of queries meets each chunk of codes in one task, its home chunk first, which finds what that chunk
    has within the bound exactly; the nearest of those are the answer. An empty table gives no rows.
    """
    able = rows.filter("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct()
    able = able.withColumn("name", F.concat_ws(",", "code"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    owners = materialize(able.withColumn("nth", nth).filter(F.col("nth") <= k + 1).select("name", "code", "id"))
    codes = owners.groupBy("name").agg(F.count("*").alias("rows"), F.first("code").alias("code"))
    asked = materialize(queries.filter("id IS NOT NULL AND code IS NOT NULL").select(F.col("id").alias("query_id"), "code").distinct())
    chunks, blocks = owners.count() // chunk_codes + 1, asked.count() // block_queries + 1
    dealt = codes.withColumn("chunk", F.pmod(F.xxhash64("name"), F.lit(chunks)).cast("int"))
    dealt = materialize(dealt.withColumn("number", F.monotonically_increasing_id()))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("home", F.pmod(F.xxhash64(F.lit(7), "query_id"), F.lit(chunks)).cast("int"))

    def search(spread: DataFrame) -> DataFrame:
        every = dealt.select("number", "code", "rows", "chunk").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = every.groupBy("chunk", "block").cogroup(spread.groupBy("chunk", "block"))
        return met.applyInPandas(_searcher(k), "query_id long, number long, distance int")

    at_home = search(asked.select("query_id", "code", "block", F.col("home").alias("chunk"), F.lit(None).cast("int").alias("bound")))
    if chunks > 1:
        at_home = materialize(at_home)
        # The distance by which the home chunk has k + 1 rows; none where it has fewer.
        met = at_home.join(dealt.select("number", "rows"), "number")
        so_far = F.sum("rows").over(Window.partitionBy("query_id").orderBy("distance"))
        bounds = met.withColumn("so_far", so_far).filter(F.col("so_far") > k).groupBy("query_id").agg(F.min("distance").alias("bound"))
        others = asked.join(bounds, "query_id", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).filter("chunk <> home")
        found = at_home.unionByName(search(others.select("query_id", "code", "block", "chunk", "bound")))
    else:
        found = at_home
    # Only codes that can still be among the k nearest get their ids.
    near = F.rank().over(Window.partitionBy("query_id").orderBy("distance"))
    found = found.withColumn("near", near).filter(F.col("near") <= k + 1).drop("near")
    named = found.join(dealt.select("number", "name"), "number")
    pairs = named.join(owners.select("name", F.col("id").alias("neighbour_id")), "name").filter("neighbour_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "neighbour_id", "distance", "rank")
