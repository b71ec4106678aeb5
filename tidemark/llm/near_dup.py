"""Near duplicates: a Jaccard join over word 5-grams by a MinHash LSH forest, followed by exact verification.

Each distinct set of 5-grams gets a signature per tree: eight MinHash digits of eight bits, one long. In order these longs are a prefix trie, and a prefix of
some digits is a node of it. Two sets are candidates if they share a node of the matched depth in some tree. The depth is the one that the formula gives for pairs
right at the threshold; it depends on no data, so that easy pairs, however many, can't cost the harder ones their match. Candidates meet in the groups of a component of the candidate graph, large ones cut into
pairs of chunks, where the Jaccard similarity of each candidate pair is worked out from the whole sets. Only counts and spanning edges leave a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import lowest_linked
from tidemark.llm.exact_dedup import MOST_BROADCAST, leave_out, normalised, row_key
from tidemark.llm.tokens import WordTable, bare
from tidemark.operators.joins import splittable_join
from tidemark.session import materialize

GRAM = 5
THRESHOLD = 0.8
TREES = 24
DIGITS = 8
RECALL = 0.9999
CHUNK_SETS = 512
CHUNK_GRAMS = 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
DIGIT_BITS = 8
SAMPLE_NODES = 4_000  # of the trie, from which pairs are drawn to measure recall
SAMPLE_MEMBERS = 8  # of each of them
LEAST_PAIRS = 500
BANDS = (0.78, 0.85, 0.9, 0.95)  # lower ends of the bands of similarity that must each meet the target


def recall_at(depth: int, trees: int, similarity: float) -> float:
    """The chance that two sets of this similarity share a prefix of `depth` digits in one of the trees."""
    return 1.0 - (1.0 - similarity**depth) ** trees


def matched_depth(trees: int, digits: int, threshold: float, target: float) -> int:
    """The longest prefix, from whole signatures down, at which a pair right at the threshold is found with the target recall, by the formula."""
    depth = digits
    while depth > 1 and recall_at(depth, trees, threshold) < target:
        depth -= 1
    if recall_at(depth, trees, threshold) < target:
        raise ValueError("the target recall needs more trees")
    return depth


def _word_hashes(words: list[str]) -> np.ndarray:
    """A hash of each word without its punctuation; 0 if nothing is left."""
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) | 1 if w else 0 for w in map(bare, words)], np.uint64)


def gram_hashes(texts: list[str], table: WordTable, gram: int = GRAM, run_chars: int = 2_000_000) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; a text of fewer words has one for all of them, one of none has none.

    Texts are split into words in runs of about `run_chars` characters, which bounds what is held at a time.
    """
    out, first, held = [], 0, 0
    for last, text in enumerate(texts, 1):
        held += len(text)
        if held >= run_chars or last == len(texts):
            out.extend(_run_hashes(texts[first:last], table, gram))
            first, held = last, 0
    return out


def _run_hashes(texts: list[str], table: WordTable, gram: int) -> list[np.ndarray]:
    split = [t.split() for t in texts]
    places = table.places([w for words in split for w in words])
    hashes = table.rows[places] if len(places) else np.empty(0, np.uint64)
    out, at = [], 0
    for words in split:
        own = hashes[at : at + len(words)]
        own = own[own != 0]
        at += len(words)
        n = max(1, len(own) - gram + 1) if len(own) else 0
        rolled = np.zeros(n, np.uint64)
        for k in range(min(gram, len(own))):
            rolled = (rolled ^ own[k : k + n]) * MIX
            rolled ^= rolled >> np.uint64(31)
        out.append(np.unique(rolled))
    return out


def signatures(sets: list[np.ndarray], trees: int, digits: int = DIGITS, seed: int = 11) -> np.ndarray:
    """sets x trees: the digits of each tree's signature, first digit in the highest bits; 0 for an empty set."""
    rng = np.random.default_rng(seed)
    odd, shift = rng.integers(1, 1 << 63, (trees, digits), np.int64).astype(np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, (trees, digits), np.int64).astype(np.uint64)
    out = np.zeros((len(sets), trees), np.uint64)
    lengths = np.array([len(s) for s in sets])
    rows = np.flatnonzero(lengths)
    ends = np.cumsum(lengths[rows])
    cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, 30_000))  # runs of sets that fit a core's cache
    cuts = np.unique(np.append(cuts, len(rows)))
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        part = rows[first:last]
        values = np.concatenate([sets[r] for r in part])
        starts = np.concatenate([[0], np.cumsum(lengths[part])[:-1]])
        for t in range(trees):
            label = np.zeros(len(part), np.uint64)
            for d in range(digits):
                mixed = (values ^ shift[t, d]) * odd[t, d]
                mixed ^= mixed >> np.uint64(32)
                least = np.minimum.reduceat(mixed * MIX, starts)
                label = (label << np.uint64(DIGIT_BITS)) | ((least * odd[t, d]) >> np.uint64(64 - DIGIT_BITS))
            out[part, t] = label << np.uint64(DIGIT_BITS * (DIGITS - digits))
    return out


def shift_of(depth: int) -> int:
    return DIGIT_BITS * (DIGITS - depth)


def common_digits(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length of the common prefix, number of equal digits) of signatures, per tree."""
    apart = np.stack([((one ^ other) >> np.uint64(shift_of(d + 1))) & np.uint64(0xFF) for d in range(DIGITS)], -1) != 0
    return np.cumprod(~apart, -1).sum(-1), (~apart).sum(-1)


def _measure(places: pd.DataFrame) -> pd.DataFrame:
    """Pairs of sets that share a node of a tree: the band of their similarity, as one half of the trees has it, and the depth at which the other half still
    matches them. The half with the node itself tells the similarity, so that the match they were drawn by is not counted."""
    out = []
    for _, rows in places.groupby("place", sort=False):
        labels = np.stack([np.frombuffer(x, np.int64) for x in rows["labels"]]).view(np.uint64)
        trees = labels.shape[1]
        inside = np.arange(trees) % 2 == rows["tree"].iat[0] % 2
        i, j = np.triu_indices(len(rows), 1)
        depth, equal = common_digits(labels[i], labels[j])
        share = equal[:, inside].sum(1) / (inside.sum() * DIGITS)
        alike = (share - 2.0**-DIGIT_BITS) / (1 - 2.0**-DIGIT_BITS)
        out.append(pd.DataFrame({"band": np.searchsorted(BANDS, alike, "right") - 1, "depth": depth[:, ~inside].max(1)}))
    return pd.concat(out, ignore_index=True).astype({"band": "int64", "depth": "int64"})


def measured_depth(counts: dict[tuple[int, int], int], floor: int, target: float, digits: int = DIGITS) -> int:
    """The longest prefix at which every band of similarity meets the target, from the numbers of pairs per (band, depth matched by half of the trees).

    Bands of fewer than LEAST_PAIRS pairs are counted with the next higher ones, the last with the one before. Of n pairs that were all found, n of n + 3 count as found; fewer
    than LEAST_PAIRS in all prove nothing.
    """
    pooled: list[dict[int, int]] = [{}]
    for band in sorted({b for b, _ in counts if b >= 0}):
        if sum(pooled[-1].values()) >= LEAST_PAIRS:
            pooled.append({})
        for (b, d), n in counts.items():
            if b == band:
                pooled[-1][d] = pooled[-1].get(d, 0) + n
    if len(pooled) > 1 and sum(pooled[-1].values()) < LEAST_PAIRS:
        last = pooled.pop()
        pooled[-1] = {d: pooled[-1].get(d, 0) + last.get(d, 0) for d in {*pooled[-1], *last}}
    if sum(pooled[0].values()) < LEAST_PAIRS:
        return floor
    for depth in range(digits, floor, -1):
        missed = [1 - sum(n for d, n in pool.items() if d >= depth) / (sum(pool.values()) + 3) for pool in pooled]
        if 1 - max(missed) ** 2 >= target:  # a pair is lost if both halves miss it
            return depth
    return floor


def descended_depth(nodes: DataFrame, floor: int, target: float) -> int:
    """`measured_depth` on pairs from at most SAMPLE_NODES nodes of the trie at the floor's depth: an estimate of how far the data would let one descend. No result depends on it."""
    members = nodes.select("node", "labels", F.posexplode("labels").alias("tree", "label"))
    members = members.select("node", "labels", "tree", F.xxhash64("tree", F.shiftright("label", shift_of(floor))).alias("place"))
    crowded = members.groupBy("place").agg(F.count("*").alias("n")).filter("n > 1")
    total = crowded.count()
    if not total:
        return floor
    drawn = F.pmod(F.xxhash64(F.lit(5), "place"), F.lit(1 << 20)) < math.ceil(min(1.0, SAMPLE_NODES / total) * (1 << 20))
    sampled = F.broadcast(materialize(crowded.filter(drawn).select("place")))  # about SAMPLE_NODES at most
    nth = F.row_number().over(Window.partitionBy("place").orderBy(F.xxhash64("node")))
    few = members.filter(drawn).join(sampled, "place").withColumn("nth", nth).filter(F.col("nth") <= SAMPLE_MEMBERS)
    few = few.select("place", "tree", F.unhex(F.concat_ws("", F.transform("labels", _little_endian))).alias("labels"))
    tasks = few.withColumn("task", F.pmod("place", F.lit(64)))
    pairs = tasks.groupBy("task").applyInPandas(_measure, "band long, depth long")
    counts = {(r["band"], r["depth"]): r["count"] for r in pairs.groupBy("band", "depth").count().collect()}
    return measured_depth(counts, floor, target)


def _signer(trees: int, digits: int, gram: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordTable(_word_hashes)
        for batch in batches:
            sets = gram_hashes(list(batch["text"]), table, gram)
            labels = signatures(sets, trees, digits).view(np.int64)
            names = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
            yield pd.DataFrame(
                {"id": batch["id"], "no_id": batch["no_id"], "digest": batch["digest"], "name": names, "size": [len(s) for s in sets], "labels": list(labels)}
            )

    return sign


def _collector(gram: int):
    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordTable(_word_hashes)
        for batch in batches:
            sets = gram_hashes(list(batch["text"]), table, gram)
            yield batch.drop(columns="text").assign(grams=[s.tobytes() for s in sets])

    return collect


def common_counts(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """How many members the sets left[i] and right[j] share, for each pair (i, j). Few pairs are intersected one by one, many by products of 0/1 matrices."""
    if len(pairs) < 200:
        return np.array([len(np.intersect1d(left[i], right[j], assume_unique=True)) for i, j in pairs], np.int64)
    both = [*left, *right]
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, column, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        if a < b:
            marks = np.zeros((len(both), width), np.float32)
            marks[owner[a:b], column[a:b] - first] = 1
            total += marks[: len(left)] @ marks[len(left) :].T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def _verify_block(block: pd.DataFrame, threshold: float, depth: int) -> pd.DataFrame:
    """The verified links between the two chunks of a block: per set the weight of its partners, and the lowest set it reaches."""
    a, b = int(block["low"].iat[0]), int(block["high"].iat[0])
    block = block.drop_duplicates("node")
    nodes, weight, size = block["node"].to_numpy(), block["weight"].to_numpy(), block["size"].to_numpy()
    labels = np.stack([np.frombuffer(x, np.int64) for x in block["labels"]]) >> shift_of(depth)
    left = np.flatnonzero(block["chunk"].to_numpy() == a)
    right = left if a == b else np.flatnonzero(block["chunk"].to_numpy() == b)
    met = np.zeros((len(left), len(right)), bool)
    for t in range(labels.shape[1]):
        met |= labels[left, t][:, None] == labels[right, t][None, :]
    if a == b:
        met = np.triu(met, 1)
    small, large = np.minimum(size[left][:, None], size[right][None, :]), np.maximum(size[left][:, None], size[right][None, :])
    met &= small >= threshold * large - 1e-9
    pairs = np.argwhere(met)
    if not len(pairs):
        return pd.DataFrame({"node": [], "links": [], "root": []}, dtype="int64")
    sets = [np.frombuffer(g, np.uint64) for g in block["grams"]]
    common = common_counts([sets[i] for i in left], [sets[i] for i in right], pairs)
    one, other = left[pairs[:, 0]], right[pairs[:, 1]]
    near = common >= threshold * (size[one] + size[other] - common) - 1e-9
    one, other = one[near], other[near]
    links = np.bincount(one, weight[other], len(nodes)) + np.bincount(other, weight[one], len(nodes))
    root = nodes.copy()
    while True:  # lowest node reached through the links, by repeated minima
        low = np.minimum(root[one], root[other])
        after = root.copy()
        np.minimum.at(after, one, low)
        np.minimum.at(after, other, low)
        if (after == root).all():
            break
        root = after
    linked = links > 0
    return pd.DataFrame({"node": nodes[linked], "links": links[linked].astype(np.int64), "root": root[linked]})


def _verifier(threshold: float, depth: int):
    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        found = [_verify_block(block, threshold, depth) for _, block in rows.groupby(["component", "low", "high"], sort=False)]
        return pd.concat(found, ignore_index=True)

    return verify


def linked(
    docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, trees: int = TREES, digits: int = DIGITS,
    recall: float = RECALL, chunk_sets: int = CHUNK_SETS, chunk_grams: int = CHUNK_GRAMS, most: int = MOST_BROADCAST,
) -> DataFrame:
    """One row per row of `docs`: id, no_id, digest (of the text), class_id, class_digest, class_no_id, links."""
    depth = matched_depth(trees, digits, threshold, recall)
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"),
        F.sha2(normalised(F.col("text")), 256).alias("digest"), F.coalesce("text", F.lit("")).alias("text"),
    )
    schema = "id long, no_id boolean, digest string, name string, size long, labels array<long>"
    signed = materialize(texts.mapInPandas(_signer(trees, digits, gram), schema))
    # One node for each distinct set; equal sets combine before the shuffle.
    sets = signed.filter("size > 0").groupBy("name").agg(
        F.min(F.struct("no_id", "id", "digest")).alias("first"), F.count("*").alias("weight"), F.min("size").alias("size"), F.min("labels").alias("labels"),
    )
    nodes = materialize(sets.withColumn("node", F.monotonically_increasing_id()))

    # A trie node at the matched depth: a tree and a prefix. Its members hang under the lowest one.
    members = nodes.select("node", F.posexplode("labels").alias("tree", "label"))
    members = members.select("node", F.xxhash64("tree", F.shiftright("label", shift_of(depth))).alias("place"))
    crowded = members.groupBy("place").agg(F.min("node").alias("lowest"), F.count("*").alias("n")).filter("n > 1")
    crowded = crowded.select(F.xxhash64("place").alias("key"), "lowest")  # keyed afresh: an exchange on both sides, which a crowded place can be split by
    met = members.withColumn("key", F.xxhash64("place")).join(crowded, "key").filter("node <> lowest")
    candidates = lowest_linked(met.select(F.col("node").alias("a"), F.col("lowest").alias("b")))

    around = candidates.join(nodes, "node").select("node", F.col("root").alias("component"), "weight", "size", "labels", "first")
    whole = around.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / chunk_sets), F.ceil(F.sum("size") / chunk_grams)).cast("long").alias("chunks")
    )
    keyed = around.withColumn("key", F.xxhash64("component")).join(whole.select(F.xxhash64("component").alias("key"), "chunks"), "key").drop("key")
    placed = materialize(keyed.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks")))
    volume = placed.agg(F.coalesce(F.sum(F.col("size") * F.col("chunks")), F.lit(0))).first()[0]
    wanted = placed.select("node", "component", "weight", "size", "chunk", "chunks", "labels", F.col("first.id").alias("id"), F.col("first.digest").alias("digest"), F.col("first.no_id").alias("no_id"))
    wanted = wanted.withColumn("labels", F.unhex(F.concat_ws("", F.transform("labels", _little_endian))))
    # Only texts that may be wanted, by a hash of their key, leave their place.
    own = F.xxhash64("no_id", "id", "digest").alias("hash")
    hashes = materialize(wanted.select(own).distinct())
    near = texts.withColumn("hash", own).join(F.broadcast(hashes), "hash", "left_semi").drop("hash") if hashes.count() <= most else texts
    found = near.join(wanted, ["id", "no_id", "digest"]).drop("id", "no_id", "digest")
    kept = "node long, component long, weight long, size long, chunk long, chunks long, labels binary"
    ready = found.select("node", "component", "weight", "size", "chunk", "chunks", "labels", "text").mapInPandas(_collector(gram), f"{kept}, grams binary")
    blocks = ready.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    blocks = blocks.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    tasks = int(volume // chunk_grams) + 1
    blocks = blocks.withColumn("task", F.pmod(F.xxhash64("component", "low", "high"), F.lit(tasks))).drop("other", "chunks")
    verified = materialize(blocks.groupBy("task").applyInPandas(_verifier(threshold, depth), "node long, links long, root long"))

    roots = lowest_linked(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    partners = verified.groupBy("node").agg(F.sum("links").alias("partners"))
    classed = nodes.join(roots, "node", "left").join(partners, "node", "left")
    classed = classed.select("name", "first", F.coalesce("root", "node").alias("root"), (F.col("weight") - 1 + F.coalesce("partners", F.lit(0))).alias("links"))
    heads = classed.groupBy("root").agg(F.min("first").alias("head"))
    classed = classed.withColumn("key", F.xxhash64("root")).join(heads.select(F.xxhash64("root").alias("key"), "head"), "key")
    facts = materialize(classed.select("name", "head", "links"))
    out = splittable_join(signed.select("id", "no_id", "digest", "name"), facts.withColumn("classed", F.lit(True)), "name", "left")
    own = F.struct("no_id", "id", "digest")
    head = F.when(F.col("classed"), F.col("head")).otherwise(own)
    return out.select("id", "no_id", "digest", head.alias("head"), F.coalesce("links", F.lit(0)).alias("links"))


def _little_endian(label):
    """The eight bytes of a long from low to high, in hexadecimal."""
    return F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(label, 8 * k).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for k in range(8)])


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, links for every row of `docs` (doc_id, text).

    Two texts are linked if the Jaccard similarity of their sets of five lower-case words in a row (punctuation at word ends apart) is
    0.8 or more. `links` counts the other rows a row is linked with, copies included. A class is a connected component of
    the links; `class_id` is its smallest doc_id (null if none has one). Texts without a word, null ones too, are a class each;
    texts of one to four words count as one 5-gram. Rows that repeat are copies of each other. Other columns are not read.
    """
    found = linked(docs, **options)
    no_id = lambda c, v: F.when(~F.col(c), F.col(v))
    return found.select(no_id("no_id", "id").alias("doc_id"), no_id("head.no_id", "head.id").alias("class_id"), F.col("links").cast("long").alias("links"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each class of `near_duplicates`, that of the smallest doc_id, with all its columns."""
    found = linked(docs, **options)
    key = row_key(F.when(~F.col("no_id"), F.col("id")), F.col("digest")).alias("key")
    marks = found.groupBy(key).agg(F.bool_or(F.struct("no_id", "id", "digest") == F.col("head")).alias("once"), F.count("*").alias("n"))
    return leave_out(docs, marks.filter("NOT once OR n > 1").select("key", "once"))
