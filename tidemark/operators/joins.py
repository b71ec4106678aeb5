"""Joins whose hot keys adaptive execution can split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def splittable_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on a text key that plans an exchange of its own for both sides.

    A side that was joined or aggregated on the key before is already partitioned by it, and the
    planner would build on that. Skew handling, however, only applies to a join fed directly by
    two exchanges. Passing the key through an expression asks for both, so that a key with a
    large share of the rows is split over several tasks. Use it where a key may be hot; where
    it cannot be, a plain join reuses the partitioning.
    """
    ours, theirs = f"{key}_left", f"{key}_right"
    fresh = F.concat(F.col(key), F.lit(""))
    keyed = right.withColumn(theirs, fresh).drop(key)
    joined = left.withColumn(ours, fresh).join(keyed, F.col(ours) == F.col(theirs), how)
    return joined.drop(ours, theirs)
