"""Interval features of series: representations, dilated windows, statistics, pooling over parts, selection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A

STATS = {
    "mean": A.mean, "std": lambda a: F.sqrt(F.when(A.variance(a) > 1e-14, A.variance(a)).otherwise(0.0)), "slope": A.slope, "min": F.array_min, "max": F.array_max,
    "median": lambda a: A.histogram_quantile(a, 0.5), "iqr": lambda a: A.histogram_quantile(a, 0.75) - A.histogram_quantile(a, 0.25),
}
POOLS = {
    "mean": A.mean, "min": F.array_min, "max": F.array_max, "std": lambda a: F.sqrt(F.when(A.variance(a) > 1e-6, A.variance(a)).otherwise(0.0)),
    "slope": A.slope, "crossings": A.crossings, "above": A.above_mean,
    "median": lambda a: A.histogram_quantile(a, 0.5), "iqr": lambda a: A.histogram_quantile(a, 0.75) - A.histogram_quantile(a, 0.25),
}


def periodogram(df: DataFrame, values: str, out: str = "values") -> DataFrame:
    """The magnitudes of the first half of the Fourier transform, neither squared nor scaled."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([np.abs(np.fft.fft(np.asarray(x, float)))[: len(x) // 2].tolist() for x in v])

    return df.withColumn(out, run(values))


def derivative(values: Column) -> Column:
    n = F.size(values)
    return F.zip_with(F.slice(values, 2, F.greatest(n - 1, F.lit(0))), F.slice(values, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)


def burg(x: np.ndarray, order: int) -> np.ndarray:
    """Autoregressive coefficients by Burg's recursion (Burg 1975)."""
    x = np.asarray(x, float) - np.mean(x)
    f, b, a = x[1:].copy(), x[:-1].copy(), np.zeros(0)
    for _ in range(order):
        den = f @ f + b @ b
        k = 2 * (f @ b) / den if den > 0 else 0.0
        a = np.append(a - k * a[::-1], k)
        f, b = (f - k * b)[1:], (b - k * f)[:-1]
        if len(f) < 1:
            break
    return np.nan_to_num(np.append(a, np.zeros(order - len(a))))


def autoregressive(df: DataFrame, values: str, out: str = "values") -> DataFrame:
    """Burg coefficients of order int(12 * (n / 100)^(1/4))."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([burg(np.asarray(x, float), int(12 * (len(x) / 100) ** 0.25)).tolist() for x in v])

    return df.withColumn(out, run(values))


def grid(n: int, lengths: tuple[int, ...] = (7, 9, 11), cap: int = 16) -> list[tuple[int, int]]:
    """(length, dilation) pairs for a series of n values: dilations are powers of two up to ``cap`` that still fit."""
    out = []
    for length in lengths:
        if length <= n:
            top = min(int(math.log2(max(1, (n - 1) // (length - 1)))), int(math.log2(cap)))
            out += [(length, 2**e) for e in range(top + 1)]
    return out


def partitions(n: int, levels: int = 3) -> list[tuple[int, int, int, int]]:
    """(level, part, start, end): 1, 2, 4.. parts of n positions, the remainder going to the first parts."""
    out = []
    for level in range(min(levels, int(math.log2(n)) + 1 if n else 0)):
        k = 2**level
        ends = [0]
        for p in range(k):
            ends.append(ends[-1] + n // k + (p < n % k))
        out += [(level, p, ends[p], ends[p + 1]) for p in range(k)]
    return out


def window_stats(df: DataFrame, key: str, values: str, length: int, dilation: int, stats: tuple[str, ...] = tuple(STATS)) -> DataFrame:
    """(key, stat, s): for each statistic the array of its values over all windows."""
    w = df.select(key, A.windows(F.col(values), length, dilation).alias("w"))
    return w.select(key, F.inline(F.array(*[F.struct(F.lit(s).alias("stat"), F.transform("w", STATS[s]).alias("s")) for s in stats])))


def pooled(df: DataFrame, key: str, s: str, n: int, levels: int = 1, pools: tuple[str, ...] = tuple(POOLS), *by: str) -> DataFrame:
    """(key, by.., level, part, pool, value): the array ``s`` of n values pooled over parts wider than one."""
    each = [
        F.struct(F.lit(lv).alias("level"), F.lit(p).alias("part"), F.lit(o).alias("pool"), POOLS[o](F.slice(F.col(s), a + 1, b - a)).alias("value"))
        for lv, p, a, b in partitions(n, levels) if b - a > 1 for o in pools
    ]
    return df.select(key, *by, F.inline(F.array(*each)))


def fisher(features: DataFrame, label: str, *by: str) -> DataFrame:
    """(by.., fisher): between-class over within-class spread of (.., label, value); 0 if either is 0."""
    c = features.groupBy(*by, label).agg(F.avg("value").alias("m"), F.count("*").alias("n"), F.coalesce(F.stddev_samp("value"), F.lit(1e-5)).alias("s"))
    every = Window.partitionBy(*by)
    mu = F.sum(F.col("m") * F.col("n")).over(every) / F.sum("n").over(every)
    d = c.withColumn("b", F.col("n") * F.pow(F.col("m") - mu, 2)).withColumn("w", F.col("n") * F.pow(F.greatest("s", F.lit(1e-4)), 2))
    r = d.groupBy(*by).agg(F.sum("b").alias("b"), F.sum("w").alias("w"))
    return r.select(*by, F.when((F.col("b") > 0) & (F.col("w") > 0), F.col("b") / F.col("w")).otherwise(0.0).alias("fisher"))


def select_top(scores: DataFrame, share: float, *by: str) -> DataFrame:
    """The floor(share * n) features of the highest score, ties by key. A row for each feature."""
    w = Window.orderBy(F.desc("fisher"), *by)
    n = F.count("*").over(Window.partitionBy())
    return scores.withColumn("rank", F.row_number().over(w)).withColumn("_n", n).where(F.col("rank") <= F.floor(F.col("_n") * share)).drop("_n")


def feature_count(n: int = 200, lengths=(7, 9, 11), cap: int = 16, levels: int = 3, pools: int = 6, stats: int = 7, share: float = 0.4) -> dict[str, int]:
    """Features of one channel: global, pooled local, raw points, selected and in all."""
    sizes = [n, n // 2, n - 1, int(12 * (n / 100) ** 0.25)]
    every = local = 0
    for m in sizes:
        for length, d in grid(m, lengths, cap):
            segments = m - (length - 1) * d
            every += stats * pools
            local += stats * pools * sum(b - a > 1 for lv, _, a, b in partitions(segments, levels) if lv)
    kept = int(share * (local + sum(sizes)))
    return {"global": every, "local": local, "raw": sum(sizes), "selected": kept, "total": every + kept}
