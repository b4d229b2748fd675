"""Ranks, running sums and exact quantiles of large groups, without sorting a group in one task.

A window over a handful of keys (labels, columns, classes) sorts each group as a whole. Here a group is cut into ranges
first: by the leading digits of a hash where rows are ranked in hashed order, by approximate quantiles where they are
ranked by value. Each range is sorted on its own; the sizes of the ranges, a table of bounded size for each group,
give the offset at which it starts. The ranges only spread the work, the results are exact.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 4  # leading hex digits of a hash: 65,536 ranges a group
SIDE = 16  # ranges of values a group: SIDE squared
ACCURACY = 100_000  # of approximate quantiles: ranges of 4 in 100,000 rows hold the exact ones


def _on(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)], F.lit(True))


def _with(df: DataFrame, table: DataFrame, by: list[str], *more: str) -> DataFrame:
    """``df`` with the columns of ``table``, which has one row for each group (and ``more``)."""
    names = [*by, *more]
    renamed = table.withColumnsRenamed({c: f"_on_{i}" for i, c in enumerate(names)})
    marks = [f"_on_{i}" for i in range(len(names))]
    return (df.join(renamed, _on(names, marks)) if names else df.crossJoin(renamed)).drop(*marks)


def join_groups(df: DataFrame, table: DataFrame, *by: str) -> DataFrame:
    """``df`` with the columns of ``table``, which has at most one row for each group; null keys match."""
    names = [f"_on_{c}" for c in by]
    renamed = table.withColumnsRenamed(dict(zip(by, names, strict=True)))
    return (df.join(renamed, _on(list(by), names), "left") if by else df.crossJoin(renamed)).drop(*names)


def hashed(df: DataFrame, order: Column, key: str, *by: str) -> DataFrame:
    """Adds _r, from 1, each row's place in its group by ``order`` (hex digits of a hash), then ``key``, and _n, the group's rows."""
    each = df.withColumn("_h", order).withColumn("_b", F.substring("_h", 1, DIGITS))
    group = Window.partitionBy(*by)
    sizes = each.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    starts = sizes.select(*by, "_b", (F.sum("_c").over(group.orderBy("_b")) - F.col("_c")).alias("_s"), F.sum("_c").over(group).alias("_n"))
    inside = each.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key)))
    return _with(inside, starts, list(by), "_b").withColumn("_r", F.col("_s") + F.col("_i")).drop("_h", "_b", "_i", "_s")


def running(counts: DataFrame, value: str, sums: list[str], *by: str) -> DataFrame:
    """Adds, to one row for each group and distinct ``value``, before_<c> and all_<c> for each of ``sums``, and next.

    before_<c> adds up the rows of smaller values, all_<c> the group; next is the next greater value. Nulls are left out.
    """
    given = counts.where(F.col(value).isNotNull())
    places = [i / SIDE**2 for i in range(1, SIDE**2)]
    cuts = given.groupBy(*by).agg(F.percentile_approx(value, places, 8 * SIDE**2).alias("_cuts"))
    less = lambda a: F.size(F.filter(a, lambda c: c < F.col(value)))
    coarse = less(F.transform(F.sequence(F.lit(SIDE - 1), F.lit(SIDE * (SIDE - 1) - 1), F.lit(SIDE)), lambda i: F.get("_cuts", i)))
    placed = _with(given, cuts, list(by)).withColumn("_b", coarse)
    placed = placed.withColumn("_b", F.col("_b") * SIDE + less(F.slice("_cuts", F.col("_b") * SIDE + 1, SIDE - 1))).drop("_cuts")
    group = Window.partitionBy(*by)
    up = group.orderBy("_b")
    parts = placed.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums], F.min(value).alias("_first"))
    starts = parts.select(
        *by, "_b", F.lead("_first").over(up).alias("_next"),
        *[(F.sum(f"_s_{c}").over(up) - F.col(f"_s_{c}")).alias(f"_o_{c}") for c in sums], *[F.sum(f"_s_{c}").over(group).alias(f"all_{c}") for c in sums],
    )
    inside = Window.partitionBy(*by, "_b").orderBy(value)
    run = placed.select("*", F.lead(value).over(inside).alias("_in"), *[(F.sum(c).over(inside) - F.col(c)).alias(f"_i_{c}") for c in sums])
    whole = _with(run, starts, list(by), "_b")
    whole = whole.withColumns({"next": F.coalesce("_in", "_next")} | {f"before_{c}": F.col(f"_o_{c}") + F.col(f"_i_{c}") for c in sums})
    return whole.drop("_b", "_in", "_next", *[f"_o_{c}" for c in sums], *[f"_i_{c}" for c in sums])


def average_ranks(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by.., value, rank): the rank of each distinct value, ties at their mean."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return running(n, value, ["n"], *by).select(*by, value, (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))


def with_rank(df: DataFrame, value: str, name: str, *by: str) -> DataFrame:
    """``df`` with the rank of ``value`` in its group as ``name``; rows without a value are left out."""
    ranks = average_ranks(df, value, *by).withColumnRenamed("rank", name)
    return _with(df, ranks, list(by), value)


def quantiles(df: DataFrame, columns: dict[str, str | Column], shares: list[float], *by: str) -> DataFrame:
    """(by.., column, share, value): exact quantiles by linear interpolation.

    Approximate quantiles, whose error in rank is bounded, bracket each exact one in a group of ACCURACY rows or more; rows
    below a bracket are counted, and only distinct values inside are ordered. Smaller groups are ordered whole.
    """
    value = {c: (F.col(x) if isinstance(x, str) else x).cast("double") for c, x in columns.items()}
    places = [min(1.0, max(0.0, s + d)) for s in shares for d in (-2 / ACCURACY, 2 / ACCURACY)]
    named = df.select(*by, *[v.alias(f"_x{i}") for i, v in enumerate(value.values())])
    ends = named.groupBy(*by).agg(*[f for i in range(len(value)) for f in (F.percentile_approx(f"_x{i}", places, ACCURACY).alias(f"_e{i}"), F.count(f"_x{i}").alias(f"_n{i}"))])
    wide = lambda i, k, end: F.when(F.col(f"_n{i}") >= ACCURACY, F.get(f"_e{i}", F.lit(k))).otherwise(F.lit(end))
    each = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(float(s)).alias("share"), F.col(f"_x{i}").alias("_v"), F.col(f"_n{i}").alias("_n"),
                 wide(i, 2 * k, -math.inf).alias("_lo"), wide(i, 2 * k + 1, math.inf).alias("_hi"))
        for i, c in enumerate(value) for k, s in enumerate(shares)
    ])
    near = _with(named, ends, list(by)).select(*by, F.inline(each)).where(F.col("_v") <= F.col("_hi"))
    cells = near.groupBy(*by, "column", "share", "_n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    at = F.col("share") * (F.col("_n") - 1)
    seen = F.sum("_c").over(Window.partitionBy(*by, "column", "share").orderBy(F.asc_nulls_first("_v")))
    held = cells.withColumn("_to", seen).withColumn("_from", F.col("_to") - F.col("_c"))
    holds = lambda k: F.max(F.when((F.col("_from") <= k) & (k < F.col("_to")), F.col("_v")))
    got = held.groupBy(*by, "column", "share", "_n").agg(holds(F.floor(at)).alias("_a"), holds(F.ceil(at)).alias("_z"))
    mixed = F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise((F.ceil(at) - at) * F.col("_a") + (at - F.floor(at)) * F.col("_z"))
    return got.select(*by, "column", "share", mixed.alias("value"))


def quantile_row(df: DataFrame, columns: dict[str, str | Column], shares: list[float], *by: str) -> DataFrame:
    """(by.., column: array of its quantiles): one row for each group; null for a column without values."""
    q = quantiles(df, columns, shares, *by)
    one = lambda c, s: F.max(F.when((F.col("column") == c) & (F.col("share") == s), F.col("value")))
    return q.groupBy(*by).agg(*[F.array(*[one(c, float(s)) for s in shares]).alias(c) for c in columns])
