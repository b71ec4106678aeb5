"""Approximate nearest neighbours by inner product: a forest of sorted hash strings, matched by their longest prefixes.

Every tree gives every vector a string of digits. A digit is the nearest of 64 signed directions drawn for that tree and place, so vectors at a small
angle share long prefixes. Inner products become angles by one more component, which brings all vectors to the largest norm. A
string is 54 bits of a long whose upper bits are the tree, so one sorted array of longs holds all trees, and a prefix is a range of it.

A query descends to the longest prefix any row shares with it, and then ascends, all trees in step: depth by depth, and tree by tree within a depth, until the
rows below the nodes reached are as many as the candidate goal. Counts per node (sums over prefixes, one digit shorter each time) give that place without looking
at a row. The goal is measured: for a bounded sample of queries all rows are scored, and the smallest goal that finds the target share of their
true neighbours is taken. Rows and queries of a node then meet in a task, which cuts each query's range out of its sorted array and scores it with
components of 8 bits; the best by that measure are scored again on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

TREES = 32
HALF = 32  # directions of a digit; each counts with both signs
DIGIT_BITS = 6
DIGITS = 9
TREE_SHIFT = DIGIT_BITS * DIGITS
TARGET_RECALL = 0.96
SAMPLE_QUERIES = 128
MARGIN = 12  # kept beyond k by the 8-bit measure
PART_ROWS = 20_000


def shift_of(depth: int) -> int:
    return DIGIT_BITS * (DIGITS - depth)


@cache
def directions(tree: int, digit: int, dims: int) -> np.ndarray:
    """dims x 32: orthonormal where there is room, else of length one."""
    drawn = np.random.default_rng([29, tree, digit, dims]).standard_normal((dims, HALF))
    return np.linalg.qr(drawn)[0] if dims >= HALF else drawn / np.linalg.norm(drawn, axis=0)


def strings(points: np.ndarray, digits: int) -> np.ndarray:
    """points x trees: tree number and hash string of `digits` digits as one long; the digits after them are 0."""
    out = np.empty((len(points), TREES), np.int64)
    places = np.arange(len(points))
    for tree in range(TREES):
        key = np.full(len(points), tree, np.int64)
        for digit in range(DIGITS):
            key <<= DIGIT_BITS
            if digit < digits:
                along = points @ directions(tree, digit, points.shape[1])
                best = np.abs(along).argmax(1)
                key |= 2 * best + (along[places, best] > 0)
        out[:, tree] = key
    return out


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a column, zeros where one is shorter than `dims`."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.asarray(column.value_lengths())
    if (lengths == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = values
    return out


def _lengths(points: np.ndarray) -> np.ndarray:
    top = np.abs(points).max(1)
    return top * np.sqrt(((points / top[:, None]) ** 2).sum(1))


def _longest(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            yield pa.RecordBatch.from_arrays([pa.array([_lengths(matrix(batch.column("v"), dims)).max()], pa.float64())], ["length"])

    return measure


def _labeller(dims: int, digits: int, longest: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Strings of rows (`as_row`, raised to the longest vector) and of queries (of length one), and the row's components as 8 bits and a scale."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            points = matrix(batch.column("v"), dims)
            near = points / longest
            raised = np.column_stack([near, np.sqrt(np.maximum(0.0, 1.0 - (near * near).sum(1)))])
            asked = np.column_stack([points / _lengths(points)[:, None], np.zeros(len(points))])
            scale = np.abs(points).max(1) / 127.0
            small = np.rint(points / scale[:, None]).astype(np.int8)
            query = batch.column("asked").to_numpy(zero_copy_only=False)
            keys = strings(raised, digits)
            query_keys = np.zeros((len(points), TREES), np.int64)
            query_keys[query] = strings(asked[query], digits)
            kind = pa.list_(pa.int64())
            columns = [
                batch.column("rep"), pa.array(list(keys), kind), pa.array([k if q else None for k, q in zip(query_keys, query, strict=True)], kind),
                pa.array([x.tobytes() for x in small], pa.binary()), pa.array(scale, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "keys", "query_keys", "small", "scale"])

    return label


def _scorer(dims: int, ids: np.ndarray, queries: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k nearest rows of a task to each of a bounded number of queries."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, owner = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for batch in filter(len, batches):
            reps = batch.column("rep").to_numpy()
            scores = queries @ matrix(batch.column("v"), dims).T
            scores[ids[:, None] == reps] = -np.inf
            both, owners = np.hstack([best, scores]), np.hstack([owner, np.broadcast_to(reps, scores.shape)])
            top = np.argpartition(-both, k - 1, 1)[:, :k]
            best, owner = np.take_along_axis(both, top, 1), np.take_along_axis(owners, top, 1)
        row, column = np.nonzero(best > -np.inf)
        columns = [pa.array(ids[row], pa.int64()), pa.array(owner[row, column], pa.int64()), pa.array(best[row, column], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["query", "rep", "score"])

    return score


# Where a query has got to: `level` is the depth it is ascending to, and `trees` of the trees are there, the others one digit deeper. In order of
# ascent: (D, 1), (D, 2), ..., (D, T), (D-1, 1), ..., (1, T). Level 0 is the root, below which all rows are.
def ascent(counts: np.ndarray) -> np.ndarray:
    """Rows below the nodes a query has reached at each step of its ascent, from `counts` (trees x depths 1 to D)."""
    trees, depths = counts.shape
    deeper = np.column_stack([counts, np.zeros(trees, np.int64)])
    steps = [np.cumsum(deeper[:, x - 1]) + deeper[:, x].sum() - np.cumsum(deeper[:, x]) for x in range(depths, 0, -1)]
    return np.concatenate(steps)


def stop(counts: np.ndarray, goal: float) -> tuple[int, int]:
    """(level, trees) of the first step with `goal` rows; (0, 0) if only the root has them."""
    trees, depths = counts.shape
    enough = np.flatnonzero(ascent(counts) >= goal)
    return (depths - int(enough[0]) // trees, int(enough[0]) % trees + 1) if len(enough) else (0, 0)


def met_at(query: np.ndarray, rows: np.ndarray, depths: int) -> np.ndarray:
    """The step of the ascent at which a query (strings of its trees) meets each of `rows` (rows x trees); one past the last for the root."""
    trees = len(query)
    same = np.stack([(query >> shift_of(x)) == (rows >> shift_of(x)) for x in range(1, depths + 1)], -1)
    length = np.cumprod(same, -1).sum(-1)  # of the common prefix, per row and tree
    step = np.where(length > 0, (depths - length) * trees + np.arange(trees), depths * trees)
    return step.min(1)


def measured_goal(samples: list[tuple[np.ndarray, np.ndarray]], floor: float, ceiling: float, target: float) -> float:
    """The smallest goal, in steps of a tenth, at which samples of (ascent, steps at which the true neighbours are met) find the target share."""
    goal = floor
    while goal <= ceiling:
        found = []
        for rows, met in samples:
            enough = np.flatnonzero(rows >= goal)
            found.append((met <= (enough[0] if len(enough) else len(rows))).mean() if len(met) else 1.0)
        if not found or np.mean(found) >= target:
            return goal
        goal *= 1.1
    return float("inf")


def _counts_of(cells: list, depths: int) -> np.ndarray:
    out = np.zeros((TREES, depths), np.int64)
    for cell in cells:
        out[cell["tree"], cell["depth"] - 1] = cell["n"]
    return out


def _planner(depths: int, goal: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stops = [stop(_counts_of(cells, depths), goal) for cells in batch["cells"]]
            yield pd.DataFrame({"query": batch["query"], "level": [s[0] for s in stops], "trees": [s[1] for s in stops]}).astype({"level": "int32", "trees": "int32"})

    return plan


def _meeter(keep: int):
    """Cuts every query's ranges out of the sorted array of its part, and keeps its nearest rows by the 8-bit measure."""

    def meet(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            order = np.argsort(rows["key"].to_numpy(), kind="stable")
            keys, reps, scale = rows["key"].to_numpy()[order], rows["rep"].to_numpy()[order], rows["scale"].to_numpy()[order]
            small = np.frombuffer(b"".join(rows["small"]), np.int8).reshape(len(rows), -1)[order]
            # Sums of products of 8-bit numbers, exact in single precision up to a thousand components.
            kind = np.float32 if small.shape[1] <= 1000 else np.float64
            asked = np.frombuffer(b"".join(queries["probe"]), np.int8).reshape(len(queries), -1).astype(kind)
            shift = queries["shift"].to_numpy()
            low = (queries["key"].to_numpy() >> shift) << shift
            first, last = np.searchsorted(keys, low), np.searchsorted(keys, low + (np.int64(1) << shift))
            ids = queries["query"].to_numpy()
            ranges, which = np.unique(np.column_stack([first, last]), axis=0, return_inverse=True)
            turn = np.argsort(which.ravel(), kind="stable")
            cuts = np.searchsorted(which.ravel()[turn], np.arange(len(ranges) + 1))
            for (a, b), start, end in zip(ranges, cuts, cuts[1:], strict=False):
                for block in range(start, end, 500):  # so that scores of a range stay some tens of MB
                    members = turn[block : min(block + 500, end)]
                    scores = (asked[members] @ small[a:b].astype(kind).T).astype(np.float64) * scale[a:b]
                    top = np.argpartition(-scores, keep - 1, 1)[:, :keep] if b - a > keep else np.broadcast_to(np.arange(b - a), scores.shape)
                    near = np.take_along_axis(scores, top, 1)
                    out.extend({"query": ids[m], "score": s, "rep": r} for m, s, r in zip(members, near, reps[a:b][top], strict=True))
        return pd.DataFrame(out, columns=["query", "score", "rep"])

    return meet


def _merger(keep: int):
    """The best of what the parts found for a query, and the query's own entry, whose copies always stand by."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query, score, rep in zip(batch["query"], batch["score"], batch["rep"], strict=True):
                reps, first = np.unique(np.concatenate(rep), return_index=True)
                best = reps[np.argsort(-np.concatenate(score)[first], kind="stable")[:keep]]
                out.append(np.union1d(best, [query]))
            yield pd.DataFrame({"query": batch["query"], "reps": out})

    return merge


def _finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _product(a: Column, b: Column) -> Column:
    """Inner product in double precision; components beyond the end of the shorter vector count as zero."""
    times = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(times, F.lit(0.0), lambda s, x: s + x)


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, target: float = TARGET_RECALL, sample: int = SAMPLE_QUERIES, part_rows: int = PART_ROWS
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each vec_id divisible by `every` the `k` other rows of largest inner product that the forest finds.

    `vectors` has vec_id and embedding. Rows without an id, and vectors that are null, empty or zero or hold a null or non-finite component take no part. A shorter vector
    counts as if filled up with zeros. Rows that repeat an id and a vector count once; of different vectors under one id the smallest (as an array) counts.
    Equal vectors are one entry of the index, whose k + 1 smallest ids stand for it, so many copies cost no more than one. Ties go to the smaller
    vec_id. With fewer than k other rows, all of them are returned, and an empty table gives no rows. Every row is indexed; scores are exact, and which rows
    are found is approximate: `target` is the share of true neighbours that the candidate goal must reach on `sample` queries.
    """
    able = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")).filter(F.col("id").isNotNull() & _finite(F.col("v")))
    if able.groupBy("id").count().filter("count > 1").limit(1).count():
        able = able.groupBy("id").agg(F.min("v").alias("v"))
    digest = F.md5(F.concat_ws(",", F.transform("v", lambda x: (x + 0).cast("string"))))  # -0 is 0
    named = materialize(able.select("id", "v", digest.alias("name")))
    entries = named.groupBy("name").agg(F.min("id").alias("rep"), F.first("v").alias("v"), F.max(F.col("id") % every == 0).alias("asked"))
    entries = materialize(entries)
    size = entries.agg(F.count("*"), F.max(F.size("v"))).first()
    total, dims = size[0], size[1] or 1
    longest = entries.select("v").mapInArrow(_longest(dims), "length double").agg(F.max("length")).first()[0] or 1.0
    depths = min(DIGITS, max(1, math.ceil(math.log(max(2, total)) / math.log(2 * HALF))))

    schema = "rep long, keys array<long>, query_keys array<long>, small binary, scale double"
    rows = materialize(entries.select("rep", "v", "asked").mapInArrow(_labeller(dims, depths, longest), schema))
    asked = rows.filter("query_keys IS NOT NULL").select(F.col("rep").alias("query"), "query_keys", F.col("small").alias("probe"))

    below = _node_counts(rows, depths)
    cells = _way_counts(below, asked)
    goal = _goal(entries, rows, cells, dims, depths, total, k, target, sample)
    plan = materialize(cells.mapInPandas(_planner(depths, goal), "query long, level int, trees int"))
    levels = [r["level"] for r in plan.select("level").distinct().collect()]  # at most ten

    found = None
    for level in sorted(levels):
        near = _meet(rows, asked.join(plan.filter(F.col("level") == level), "query"), level, depths, below[level], k + 1 + MARGIN, part_rows)
        found = near if found is None else found.unionByName(near)
    if found is None:
        return named.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = found.groupBy("query").agg(F.collect_list("score").alias("score"), F.collect_list("rep").alias("rep"))  # trees x (k + 13) at most, per query
    pairs = best.mapInPandas(_merger(k + 1 + MARGIN), "query long, reps array<long>").select("query", F.explode("reps").alias("rep"))

    scored = pairs.join(entries.select("rep", F.col("v").alias("there")), "rep").join(entries.select(F.col("rep").alias("query"), "v"), "query")
    scored = scored.select("query", "rep", _product(F.col("v"), F.col("there")).alias("score"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    members = named.select("name", "id").withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    members = members.withColumn("rep", F.min("id").over(Window.partitionBy("name"))).select("rep", "id")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    ranked = scored.join(members, "rep").withColumn("place", place).filter(F.col("place") <= k + 1)
    lists = ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("near"))

    heads = named.filter(F.col("id") % every == 0).select("name", F.col("id").alias("query_id"))
    reps = entries.filter("asked").select(F.concat("name", F.lit("")).alias("name"), F.col("rep").alias("query"))
    heads = heads.withColumn("name", F.concat("name", F.lit(""))).join(reps, "name").select("query_id", F.xxhash64("query").alias("key"))  # keyed afresh, so
    lists = lists.select(F.xxhash64("query").alias("key"), "near")  # that a vector with many ids may be split
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = heads.join(lists, "key").select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def _node(key: Column | str, depth: int) -> Column:
    return F.shiftright(key, shift_of(depth))


def _node_counts(rows: DataFrame, depths: int) -> list[DataFrame]:
    """(node, n) of each depth from the root on: how many rows are below a node. Each depth is added up from the next one."""
    level = rows.select(F.explode("keys").alias("key")).groupBy(_node("key", depths).alias("node")).agg(F.count("*").alias("n"))
    out = []
    for _ in range(depths):
        out.append(materialize(level))
        level = out[-1].groupBy(F.shiftright("node", DIGIT_BITS).alias("node")).agg(F.sum("n").alias("n"))
    root = rows.agg(F.count("*").alias("n")).select(F.lit(0).cast("long").alias("node"), "n")
    return [root, *reversed(out)]


def _way_counts(below: list[DataFrame], asked: DataFrame) -> DataFrame:
    """query, cells (tree, depth, n): how many rows are below each node on the query's way, depths 1 to D."""
    depths = len(below) - 1
    counts = below[1].select(F.lit(1).alias("depth"), "node", "n")
    for depth in range(2, depths + 1):
        counts = counts.unionByName(below[depth].select(F.lit(depth).alias("depth"), "node", "n"))
    ways = asked.select("query", F.posexplode("query_keys").alias("tree", "key"))
    ways = ways.select("query", "tree", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _node("key", d).alias("node")) for d in range(1, depths + 1)])).alias("x"))
    found = ways.select("query", "tree", "x.depth", "x.node").join(counts, ["depth", "node"], "left")
    cells = F.collect_list(F.struct("tree", "depth", F.coalesce("n", F.lit(0)).alias("n")))
    return materialize(found.groupBy("query").agg(cells.alias("cells")))


def _goal(entries: DataFrame, rows: DataFrame, cells: DataFrame, dims: int, depths: int, total: int, k: int, target: float, sample: int) -> float:
    """The candidate goal, measured on `sample` queries (those with the smallest hashes) against all rows. At least one tree then has k + 1 rows."""
    drawn = entries.filter("asked").select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()
    if not drawn:
        return float("inf")
    ids = np.array([r["rep"] for r in drawn], np.int64)
    points = np.zeros((len(drawn), dims))
    for at, r in enumerate(drawn):
        points[at, : len(r["v"])] = r["v"]
    true = entries.select("rep", "v").mapInArrow(_scorer(dims, ids, points, k), "query long, rep long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))
    true = materialize(true.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rep"))
    near: dict[int, list] = {}
    for r in true.join(rows.select("rep", "keys"), "rep").collect():  # sample x k strings
        near.setdefault(r["query"], []).append(r["keys"])
    wanted = entries.sparkSession.createDataFrame([(int(i),) for i in ids], "query long")
    ways = cells.join(F.broadcast(wanted), "query").join(rows.select(F.col("rep").alias("query"), "query_keys"), "query").collect()
    samples = []
    for r in ways:
        mine = np.array(near.get(r["query"], []), np.int64).reshape(-1, TREES)
        met = met_at(np.array(r["query_keys"], np.int64), mine, depths) if len(mine) else np.empty(0)
        samples.append((ascent(_counts_of(r["cells"], depths)), met))
    return measured_goal(samples, TREES * (k + 1) + 1, float(total) * TREES, target)


def _meet(rows: DataFrame, queries: DataFrame, level: int, depths: int, below: DataFrame, keep: int, part_rows: int) -> DataFrame:
    """query, score (list), rep (list): the nearest rows of the nodes that queries stopping at `level` have reached; at level 0 the root is the only node.

    Nodes are dealt to parts. One with more rows or queries than a part holds is cut into chunks of rows and blocks of queries, each pair of which meets once.
    `below` counts the rows of each node of the level.
    """
    cuts = lambda n: F.ceil(n / part_rows).cast("long")
    if level == 0:
        zero = F.lit(0).cast("long")
        grid = (cuts(F.lit(below.first()["n"])).alias("chunks"), cuts(F.lit(queries.count())).alias("blocks"))
        ours = rows.select("rep", zero.alias("key"), "small", "scale", zero.alias("part"), *grid)
        theirs = queries.select("query", "probe", zero.alias("key"), F.lit(shift_of(1)).alias("shift"), zero.alias("part"), *grid)
    else:
        parts = F.lit(below.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // part_rows + 1)
        ours = rows.select("rep", F.explode("keys").alias("key"), "small", "scale").withColumn("node", _node("key", level))
        theirs = queries.select("query", "probe", "trees", F.posexplode("query_keys").alias("tree", "key")).withColumn("node", _node("key", level))
        deeper = shift_of(level + 1) if level < depths else -1
        shift = F.when(F.col("tree") < F.col("trees"), F.lit(shift_of(level))).otherwise(F.lit(deeper))
        theirs = theirs.withColumn("shift", shift).filter("shift >= 0").drop("trees", "tree")
        busy = theirs.groupBy("node").agg(F.count("*").alias("queries"))
        large = below.join(busy, "node").filter((F.col("n") > part_rows) | (F.col("queries") > part_rows))
        large = materialize(large.select("node", cuts(F.col("n")).alias("chunks"), cuts(F.col("queries")).alias("blocks")))
        ours, theirs = (side.join(large, "node", "left").withColumn("part", F.pmod(F.xxhash64("node"), parts)).drop("node") for side in (ours, theirs))
    ours, theirs = _dealt(ours, "rep", "chunk", "block"), _dealt(theirs, "query", "block", "chunk")
    where = ["part", "chunk", "block"]
    return ours.groupBy(*where).cogroup(theirs.groupBy(*where)).applyInPandas(_meeter(keep), "query long, score array<double>, rep array<long>")


def _dealt(side: DataFrame, by: str, own: str, other: str) -> DataFrame:
    """Rows with one piece of their own side (`own`, by hash), and every piece of the other side."""
    one = F.lit(1).cast("long")
    pieces, others = F.coalesce(f"{own}s", one), F.coalesce(f"{other}s", one)
    side = side.withColumn(own, F.pmod(F.xxhash64(by), pieces))
    return side.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), others - 1))).drop("chunks", "blocks")
