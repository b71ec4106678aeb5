"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def lowest_linked(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long): the smallest node reachable from it.

    Each round hangs every node's larger neighbours, then its smaller ones, under the smallest of them. The number of edges never
    grows and rounds are few (a logarithm of the largest component, in practice). Each round is stored, which cuts lineage.
    Rows with equal ends make a node of its own.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _under_lowest(both).filter("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
        loops = current.filter("a = b")
        large = large.unionByName(loops).distinct()
        lowest = _under_lowest(large)
        small = lowest.select(F.col("v").alias("a"), F.col("low").alias("b")).unionByName(lowest.select(F.col("u").alias("a"), F.col("low").alias("b")))
        after = materialize(small.filter("a <> b").unionByName(loops).distinct())
        if _mark(after) == _mark(current):
            break
        current = after
    roots = current.filter("a <> b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    tops = current.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(tops.distinct()).groupBy("node").agg(F.min("root").alias("root"))


def _under_lowest(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the smallest of u and its neighbours; a node with very many edges may be split."""
    low = edges.groupBy("a").agg(F.min("b").alias("least")).select(F.xxhash64("a").alias("key"), F.least("a", "least").alias("low"), F.col("a").alias("owner"))
    keyed = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), F.xxhash64("a").alias("key"))
    return keyed.join(low, "key").filter("owner = u").select("u", "v", "low")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 20)))).first())
