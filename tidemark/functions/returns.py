"""Return arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def simple_return(entry: Column, exit_: Column) -> Column:
    """Exit over entry minus one; a zero entry price gives null instead of an error."""
    return F.try_divide(exit_, entry) - F.lit(1.0)


def forward_return(
    entry: Column,
    exit_: Column,
    delisted: Column | None = None,
    recovery: Column | None = None,
) -> Column:
    """Total return of one holding; a delisting is booked at its recovery value.

    The default recovery of nothing gives -100 %. An entry price that is not positive has no
    meaningful return: it yields null here and is counted by the contract check.
    """
    delisted = F.lit(False) if delisted is None else F.coalesce(delisted, F.lit(False))
    recovery = F.lit(0.0) if recovery is None else F.coalesce(recovery, F.lit(0.0))
    final = F.when(delisted, recovery).otherwise(exit_)
    return F.when(entry > 0, simple_return(entry, final))
