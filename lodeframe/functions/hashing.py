"""Random choices by md5 of a seed and a key: the same at any partitioning, and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: str | int, *keys: str | Column) -> Column:
    """The md5 hex digits of ``seed:key:key...``; ordering by it is a shuffle."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def uniform(seed: str | int, *keys: str | Column) -> Column:
    """A number in [0, 1) from the first eight digits of ``draw``."""
    return F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
