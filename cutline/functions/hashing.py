"""Repeatable pseudo-random numbers that depend on row content only.

A row gets the same number on every engine, partitioning and retry, so a lost
executor cannot move a row between the training and the test side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 32


def stable_digest(*parts: Column | str, seed: int = 42) -> Column:
    """128-bit digest of integer and string columns, as 32 hexadecimal digits."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def stable_hash(*parts: Column | str, seed: int = 42) -> Column:
    """Uniform integer in [0, 2**32) from integer and string columns."""
    return F.conv(F.substring(stable_digest(*parts, seed=seed), 1, 8), 16, 10).cast("long")
