"""Fixed-size seeded samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import EVENT_KEY


def seeded_sample(
    df: DataFrame, n: int | None, seed: int = 1, key: Sequence[str] = EVENT_KEY
) -> DataFrame:
    """Exactly n rows (all of them if there are fewer, or if n is None or 0).

    Rows are ordered by a hash of their key and the seed, so the draw does not depend on
    partitioning; the plan is a top-n.
    """
    if not n:
        return df
    rank = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))).cast("binary"))
    return df.orderBy(rank, *key).limit(n)
