"""Preparing tables: audits, projections, splits, folds, masks, column filters."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import draw, uniform
from .ranks import hashed, running
from .stats import missing_fraction, spearman


def audit_ranges(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values outside their inclusive range become null; None leaves a side open. One projection for all columns."""
    def kept(c: str) -> Column:
        low, high = ranges[c]
        ok = [F.col(f"`{c}`") >= low] * (low is not None) + [F.col(f"`{c}`") <= high] * (high is not None)
        return F.when(reduce(lambda a, b: a & b, ok), F.col(f"`{c}`")).alias(c)

    return df.select(*[kept(c) if c in ranges and ranges[c] != (None, None) else F.col(f"`{c}`") for c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def numeric_columns(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """The numeric columns that aren't in ``drop``; names in ``drop`` that don't exist are ignored."""
    return df.select(*[F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in drop])


def labelled(df: DataFrame, label: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a label, the label as int, columns in ``drop`` gone."""
    return df.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("int")).drop(*drop)


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds Split: the first round(share * n) rows of each label in hashed order are Test, the rest Train."""
    ranked = hashed(df, draw(seed, key), key, label)
    return ranked.withColumn("Split", F.when(F.col("_r") <= F.round(F.lit(share) * F.col("_n")), "Test").otherwise("Train")).drop("_r", "_n")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold 0..k-1, dealt round by round within each label in hashed order."""
    ranked = hashed(df, draw(seed, key), key, label)
    return ranked.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r", "_n")


def subject_split(series: DataFrame, subject: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """All rows of a subject move together; a subject's label is its commonest, the smallest of a tie."""
    subjects = series.groupBy(subject).agg(F.mode(label, True).alias("_label"))
    tagged = stratified_split(subjects, subject, "_label", share, seed).select(F.col(subject).alias("_s"), "Split")
    return series.join(tagged, F.col(subject) == F.col("_s")).drop("_s")


def describe_split(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of each label in each half."""
    n = df.groupBy("Split", label).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("Split")))


def melt(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, value): one row for each cell."""
    return df.unpivot([key], columns, "column", "value")


def cell_mask(df: DataFrame, key: str, columns: list[str], share: float = 0.1, seed: int = 42) -> DataFrame:
    """(key, column, value): floor(share * observed) cells of each column to hide, the first in hashed order."""
    cells = melt(df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]), key, columns).where(F.col("value").isNotNull())
    ranked = hashed(cells, draw(seed, "column", key), key, "column")
    return ranked.where("_r <= floor(_n * " + str(share) + ")").drop("_r", "_n")


def column_bootstrap(df: DataFrame, key: str, columns: list[str], seed: int = 42) -> DataFrame:
    """(key, column, value): each column resampled with replacement on its own, so joint structure is gone.

    A cell takes the value ranked hash mod n in its column, by ``key``, a unique number. The lookup is a join, so no
    column is collected.
    """
    cells = melt(df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]), key, columns).where(F.col("value").isNotNull())
    ranked = running(cells.withColumn("_one", F.lit(1).cast("long")), key, ["_one"], "column").withColumnsRenamed({"before__one": "_r", "all__one": "_n"})
    pick = F.conv(F.substring(draw(seed, "column", key), 1, 8), 16, 10).cast("long") % F.col("_n")
    wanted = ranked.select(key, "column", pick.alias("_p"))
    source = ranked.select(F.col("column").alias("_c"), F.col("_r").alias("_q"), "value")
    return wanted.join(source, (F.col("column") == F.col("_c")) & (F.col("_p") == F.col("_q"))).select(key, "column", "value")


def missing_filter(df: DataFrame, columns: list[str], most: float = 0.5) -> list[str]:
    """Columns whose missing share is at most ``most``; decided on the table given, one row is read back."""
    row = missing_fraction(df, columns).collect()
    bad = {r["column"] for r in row if r["missing"] > most}
    return [c for c in columns if c not in bad]


def redundant_columns(df: DataFrame, columns: list[str], most: float = 0.9) -> DataFrame:
    """(column): those that correlate by rank above ``most`` with any earlier column, itself dropped or not."""
    return spearman(df, columns).where(F.abs("rho") > most).select(F.col("b").alias("column")).distinct()


def tag_and_union(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both halves in one table with Split; test rows get is_outlier 0."""
    return train.withColumn("Split", F.lit("Train")).unionByName(
        test.withColumn("is_outlier", F.lit(0)).withColumn("Split", F.lit("Test")), allowMissingColumns=True
    )


def validate_split(df: DataFrame, label: str, low: int = 0, high: int = 3) -> DataFrame:
    """One row: whether tags are known, labels complete and in range, and the size of each half."""
    return df.agg(
        F.bool_and(F.col("Split").isin("Train", "Test")).alias("tags_ok"),
        F.bool_and(F.col(label).isNotNull()).alias("labels_complete"),
        F.bool_and(F.coalesce(F.col(label).between(low, high), F.lit(True))).alias("labels_in_range"),
        F.count_if(F.col("Split") == "Train").alias("n_train"),
        F.count_if(F.col("Split") == "Test").alias("n_test"),
    )


def jitter(df: DataFrame, key: str, values: str, sigma: float = 1e-6, seed: int = 42) -> DataFrame:
    """``values`` with normal noise of deviation ``sigma``, by Box and Muller's transform of two hashed draws for each value."""
    u = lambda what, i: uniform(f"{seed}:{what}", key, i)
    noise = lambda i: F.sqrt(-2 * F.log(1 - u("r", i))) * F.cos(2 * math.pi * u("a", i))
    return df.withColumn(values, F.transform(values, lambda x, i: x + sigma * noise(i)))


def stack_columns(blocks: list[DataFrame], key: str, values: str) -> DataFrame:
    """(key, values): blocks of columns side by side, in the order given, for keys that are in every block."""
    out = blocks[0].select(key, F.col(values).alias("_0"))
    for i, b in enumerate(blocks[1:], 1):
        out = out.join(b.select(key, F.col(values).alias(f"_{i}")), key)
    return out.select(key, F.concat(*[f"_{i}" for i in range(len(blocks))]).alias(values))


def resample_indices(df: DataFrame, key: str, rounds: int, seed: int = 42) -> DataFrame:
    """(round, key, place): for each round all keys in hashed order; the first of them train, the rest test, as the caller cuts."""
    each = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    return hashed(each, draw(seed, "round", key), key, "round").select("round", key, F.col("_r").alias("place"))
