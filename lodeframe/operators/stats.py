"""Aggregates and statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import join_groups, quantile_row, with_rank


def missing_fraction(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing): one pass over the table, then a row for each column."""
    one = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "missing")


def class_shares(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share, weight, is_majority): weight balances classes, n / (k * n_c)."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # a row for each class
    return (
        n.withColumn("share", F.col("n") / F.sum("n").over(every))
        .withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))
        .withColumn("is_majority", F.col("n") == F.max("n").over(every))
    )


def correlation(a: str, b: str):
    """Pearson's r over rows where both are observed; null where either is constant there."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    sd = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(sd > 0, F.covar_pop(x, y) / sd)


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for a before b, over rows where both are observed; all pairs in one aggregation."""
    pairs = list(combinations(columns, 2))
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(a, b).alias("r")) for a, b in pairs]).alias("x"))
    return one.select(F.inline("x"))


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, rho) for a before b; ranks are taken among the rows where both are observed.

    Rows are unpivoted to pairs once, so every pair is ranked in the same shuffles, its distinct values in ranges.
    """
    pairs = [(i, j) for i, j in combinations(range(len(columns)), 2)]
    cells = F.array(*[
        F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"`{columns[i]}`").cast("double").alias("x"), F.col(f"`{columns[j]}`").cast("double").alias("y"))
        for i, j in pairs
    ])
    long = df.select(F.inline(cells)).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    ranked = with_rank(with_rank(long, "x", "rx", "a", "b"), "y", "ry", "a", "b")
    return ranked.groupBy("a", "b").agg(correlation("rx", "ry").alias("rho"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """(by.., bin, n): equal bins from 1; the upper end counts with the last bin."""
    index = F.least(F.lit(bins), F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int") + 1)
    return df.where(F.col(value).between(low, high)).groupBy(*by, index.alias("bin")).agg(F.count("*").alias("n"))


def box_summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Quartiles and extremes of each group, exact, by linear interpolation."""
    q = quantile_row(df, {"_q": value}, [0.25, 0.5, 0.75], *by)
    ends = df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    return join_groups(ends, q, *by).select(*by, "low", *[F.col("_q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))], "high", "n")


def group_outcome(df: DataFrame, flag: str, label: str) -> DataFrame:
    """(label, n_flagged, share_of_class, share_of_all): flagged rows by class."""
    n = df.groupBy(label).agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("long")).alias("n_flagged"))
    return n.select(label, "n_flagged", (F.col("n_flagged") / F.col("n")).alias("share_of_class"), (F.col("n_flagged") / F.sum("n").over(Window.partitionBy())).alias("share_of_all"))


def symbol_histogram(df: DataFrame, label: str, symbols: str) -> DataFrame:
    """Counts and shares of array elements overall (label null) and by class, by grouping sets."""
    each = df.select(label, F.explode(symbols).alias("symbol"))
    n = each.groupingSets([["symbol"], [label, "symbol"]], label, "symbol").agg(F.count("*").alias("n"), F.grouping(label).alias("g"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("g", label))).drop("g")
