"""Sequential patterns over symbol strings, one character for each symbol.

A pattern is contained in a sequence if it occurs contiguously (gap 1), or with each next symbol within ``gap``
positions of the one before.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import paa
from .ranks import quantile_row


def discretise(series: DataFrame, key: str, label: str, values: str, segments: int) -> DataFrame:
    """(key, label, seq): L, M or H for each segment mean, by the terciles of all means of the table."""
    means = series.select(key, label, paa(F.col(values), segments).alias("m")).where("m is not null")
    low, high = quantile_row(means.select(F.explode("m").alias("v")), {"q": "v"}, [100 / 3 / 100, 200 / 3 / 100]).first()["q"]
    symbol = lambda v: F.when(v < F.lit(low), "L").when(v < F.lit(high), "M").otherwise("H")
    return means.select(key, label, F.array_join(F.transform("m", symbol), "").alias("seq"))


def _support(found: DataFrame, sizes: DataFrame, share: float) -> DataFrame:
    least = F.greatest(F.lit(1), F.floor(F.col("size") * F.lit(share)))
    on = [c for c in sizes.columns if c != "size"]
    joined = found.join(F.broadcast(sizes), on) if on else found.crossJoin(F.broadcast(sizes))  # a row for each class
    return joined.where(F.col("n") >= least).select(*on, "pattern", F.length("pattern").alias("length"), "n", (F.col("n") / F.col("size")).alias("support"))


def frequent(seqs: DataFrame, share: float, *by: str, longest: int | None = None) -> DataFrame:
    """(by.., pattern, length, n, support) of contiguous patterns in at least floor(share * sequences), one at least.

    One pass: every distinct substring of every sequence is counted. Short sequences have few (20 symbols, 210).
    """
    top = F.length("seq") if longest is None else F.least(F.length("seq"), F.lit(longest))
    starts = F.sequence(F.lit(1), F.length("seq"))
    subs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(top, F.length("seq") - i + 1)), lambda n: F.substring(F.col("seq"), i, n))))
    each = seqs.where(F.length("seq") > 0).select(*by, F.explode(F.array_distinct(subs)).alias("pattern"))
    sizes = seqs.groupBy(*by).agg(F.count("*").alias("size"))
    return _support(each.groupBy(*by, "pattern").agg(F.count("*").alias("n")), sizes, share)


def maximal(found: DataFrame, *by: str) -> DataFrame:
    """Patterns contained in no longer frequent pattern of their class.

    Support never grows with length, so it is enough to look one symbol longer: both neighbours of a pattern are found
    by equality, without comparing all pairs.
    """
    longer = found.where("length > 1")
    keys = [F.col(c) for c in by]
    shorter = longer.select(*keys, F.expr("substring(pattern, 2)").alias("pattern")).unionByName(
        longer.select(*keys, F.expr("substring(pattern, 1, length - 1)").alias("pattern"))
    ).distinct()
    return found.join(shorter, [*by, "pattern"], "left_anti")


def gap_pattern(pattern: str, gap: int) -> str:
    return f".{{0,{gap - 1}}}".join(pattern) if gap > 1 else pattern


def frequent_gapped(seqs: DataFrame, share: float, gap: int, longest: int | None = None) -> DataFrame:
    """(pattern, length, n, support) with gaps, level by level until none is left; candidates join where tail equals head.

    A level's candidates are at most its frequent patterns times the alphabet. They are few, and broadcast.
    """
    seqs = seqs.select("seq").persist()  # read once for each level
    n = seqs.count()
    least = max(1, math.floor(n * share))
    spark = seqs.sparkSession
    level = [r[0] for r in seqs.select(F.explode(F.array_distinct(F.split("seq", ""))).alias("s")).where("s <> ''").groupBy("s").count().where(F.col("count") >= least).select("s").collect()]
    candidates, out = sorted(level), []
    while candidates and (longest is None or len(candidates[0]) <= longest):
        table = spark.createDataFrame([(c, gap_pattern(c, gap)) for c in candidates], "pattern string, re string")
        hits = seqs.join(F.broadcast(table), F.expr("seq rlike re")).groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        kept = {r["pattern"]: r["n"] for r in hits.collect()}
        out += sorted(kept.items())
        candidates = sorted(a + b[-1] for a in kept for b in kept if a[1:] == b[:-1])
    seqs.unpersist()
    return spark.createDataFrame([(p, len(p), c, c / n) for p, c in out], "pattern string, length int, n long, support double")


def maximal_gapped(found: DataFrame, gap: int) -> DataFrame:
    """Longest first, patterns contained with ``gap`` in no pattern kept before them.

    With gaps containment isn't transitive, so what is kept depends on the order. Frequent patterns are few (see
    ``frequent_gapped``) and go through the driver.
    """
    import re

    rows = sorted(found.select("pattern").collect(), key=lambda r: (-len(r[0]), r[0]))
    kept: list[str] = []
    for (p,) in rows:
        if not any(len(q) > len(p) and re.search(gap_pattern(p, gap), q) for q in kept):
            kept.append(p)
    some = found.sparkSession.createDataFrame([(p,) for p in kept], "pattern string")
    return found.join(F.broadcast(some), "pattern", "left_semi")


def contrast(maximal_by: DataFrame, frequent_by: DataFrame, label: str) -> DataFrame:
    """Maximal patterns of each class, with whether another class has them maximal, or frequent at all."""
    other = lambda df, name: df.select(F.col("pattern").alias("_p"), F.col(label).alias("_l")).groupBy("_p").agg(F.count("*").alias(name))
    m, f = other(maximal_by, "_m"), other(frequent_by, "_f").withColumnRenamed("_p", "_q")
    return maximal_by.join(m, F.col("pattern") == F.col("_p")).join(f, F.col("pattern") == F.col("_q")).select(
        label, "pattern", "length", "n", "support", (F.col("_m") == 1).alias("unique_maximal"), (F.col("_f") == 1).alias("unique_frequent")
    )


def shared(maximal_by: DataFrame, label: str, a, b) -> DataFrame:
    """(pattern, support_a, support_b): patterns maximal in both classes."""
    x = maximal_by.where(F.col(label) == a).select("pattern", F.col("support").alias("support_a"))
    y = maximal_by.where(F.col(label) == b).select("pattern", F.col("support").alias("support_b"))
    return x.join(y, "pattern")


def with_duration(found: DataFrame, window: int, minutes: float = 30.0) -> DataFrame:
    """Adds hours: length * window * minutes / 60."""
    return found.withColumn("hours", F.col("length") * window * F.lit(minutes) / 60)
