"""Series: regular grids, spike filter, interpolation, scaling, differences, decomposition.

A long table has one row for each (series, t); an array table has one row for each (series, channel) with its values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_grid(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, t, x): the mean of each day from the table's first to its last, null on days without rows."""
    day = F.to_date(F.col(ts).cast("timestamp"))
    bounds = events.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    mean = events.groupBy(key, day.alias("day")).agg(F.avg(value).alias("x"))
    full = events.select(key).distinct().crossJoin(F.broadcast(bounds)).select(key, "lo", F.explode(F.sequence("lo", "hi")).alias("day"))
    return full.join(mean, [key, "day"], "left").select(key, F.datediff("day", "lo").alias("t"), "x")


def to_arrays(long: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """(key, values): each series' values in order of t."""
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(value).alias("v")))), lambda s: s["v"]).alias("values"))


def _median(a: Column) -> Column:
    n = F.size(a)
    s = F.array_sort(a)
    return F.when(n > 0, (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2)


def spike_flags(long: DataFrame, key: str, t: str, value: str, window: int = 7, sigma: float = 4.5) -> DataFrame:
    """Adds median, mad and spike: further than sigma * 1.4826 * MAD from the median of a centred window.

    Windows are truncated at the ends of a series and skip nulls. A window whose MAD is 0 flags any value that
    differs from its median.
    """
    h = window // 2
    w = Window.partitionBy(key).orderBy(t).rowsBetween(-h, h)
    near = long.withColumn("_w", F.collect_list(value).over(w)).withColumn("median", _median(F.col("_w")))
    mad = _median(F.transform("_w", lambda x: F.abs(x - F.col("median"))))
    out = near.withColumn("mad", mad).drop("_w")
    return out.withColumn("spike", F.coalesce(F.abs(F.col(value) - F.col("median")) > F.lit(sigma * 1.4826) * F.col("mad"), F.lit(False)))


def remove_spikes(long: DataFrame, key: str, t: str, value: str, window: int = 7, sigma: float = 4.5) -> DataFrame:
    """(key, t, value, cleaned): spikes become null."""
    f = spike_flags(long, key, t, value, window, sigma)
    return f.select(key, t, value, F.when(~F.col("spike"), F.col(value)).alias("cleaned"))


def removed_values(cleaned: DataFrame, value: str, new: str = "cleaned") -> DataFrame:
    """The audit log: rows that had a value and lost it."""
    return cleaned.where(F.col(value).isNotNull() & F.col(new).isNull()).drop(new)


def interpolate(long: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Adds filled: linear between valid neighbours by row position, the nearest valid value at the ends."""
    w = Window.partitionBy(key).orderBy(t)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    x = F.col(value)
    df = long.withColumn("_i", F.row_number().over(w))
    at = F.when(x.isNotNull(), F.col("_i"))
    df = df.select(
        "*", F.last(x, True).over(back).alias("_p"), F.last(at, True).over(back).alias("_pi"),
        F.first(x, True).over(ahead).alias("_n"), F.first(at, True).over(ahead).alias("_ni"),
    )
    inner = F.col("_p") + (F.col("_n") - F.col("_p")) * (F.col("_i") - F.col("_pi")) / (F.col("_ni") - F.col("_pi"))
    return df.withColumn("filled", F.coalesce(x, inner, F.col("_p"), F.col("_n"))).drop("_i", "_p", "_pi", "_n", "_ni")


def fill_edges(long: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Adds carried: the last valid value, else the next."""
    w = Window.partitionBy(key).orderBy(t)
    return long.withColumn("carried", F.coalesce(
        F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    ))


def scale_stats(train: DataFrame, value: str, *by: str) -> DataFrame:
    """(by.., mu, sigma) with the population deviation; a constant channel gets sigma 1."""
    s = train.groupBy(*by).agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sigma"))
    return s.withColumn("sigma", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.lit(1.0)))


def scale(df: DataFrame, stats: DataFrame, value: str, *by: str) -> DataFrame:
    """Adds z with the statistics of the training half; one row for each channel is broadcast."""
    joined = df.join(F.broadcast(stats), list(by)) if by else df.crossJoin(F.broadcast(stats))
    return joined.withColumn("z", (F.col(value) - F.col("mu")) / F.col("sigma")).drop("mu", "sigma")


def difference(long: DataFrame, key: str, t: str, value: str) -> DataFrame:
    return long.withColumn("diff", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(t)))


def window_moments(long: DataFrame, key: str, t: str, value: str, length: int) -> DataFrame:
    """(key, t, mean, sd) of every full window that starts at t, from two running sums."""
    w = Window.partitionBy(key).orderBy(t).rowsBetween(0, length - 1)
    df = long.select(key, t, F.sum(value).over(w).alias("s"), F.sum(F.col(value) * F.col(value)).over(w).alias("q"), F.count(value).over(w).alias("n"))
    mean = F.col("s") / length
    return df.where(F.col("n") == length).select(key, t, mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / length - mean * mean)).alias("sd"))


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Locally linear fits with tricube weights (Cleveland et al. 1990)."""
    out = np.empty(len(at))
    span = min(span, len(x))
    for k, a in enumerate(at):
        d = np.abs(x - a)
        h = max(np.partition(d, span - 1)[span - 1], 1e-12) * (1 if span < len(x) else 1.001)
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        w = w if weights is None else w * weights
        if w.sum() < 1e-12:
            out[k] = y[np.argmin(d)]
            continue
        m = (w * x).sum() / w.sum()
        v = (w * (x - m) ** 2).sum()
        b = (w * (x - m) * y).sum() / v if v > 1e-12 else 0.0
        out[k] = (w * y).sum() / w.sum() + b * (a - m)
    return out


def stl(y: np.ndarray, period: int, rounds: int = 2, robust: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, residual), whose sum is ``y``; by cycle-subseries and trend smoothing in turn."""
    n = len(y)
    x = np.arange(n, dtype=float)
    trend, seasonal, rho = np.zeros(n), np.zeros(n), np.ones(n)
    span = int(np.ceil(1.5 * period / (1 - 1.5 / 35))) | 1
    for _ in range(robust + 1):
        for _ in range(rounds):
            cycle = np.empty(n)
            for p in range(period):
                k = np.arange(p, n, period)
                if len(k):
                    cycle[k] = loess(k.astype(float), (y - trend)[k], k.astype(float), 7, rho[k])
            low = pd.Series(cycle).rolling(min(period, n), center=True, min_periods=1).mean().to_numpy()
            seasonal = cycle - low
            trend = loess(x, y - seasonal, x, span, rho)
        r = np.abs(y - trend - seasonal)
        m = 6 * np.median(r)
        rho = np.clip(1 - (r / m) ** 2, 0, None) ** 2 if m > 0 else np.ones(n)
    return trend, seasonal, y - trend - seasonal


def decompose(long: DataFrame, key: str, t: str, value: str, period: int) -> DataFrame:
    """(key, t, value, trend, seasonal, residual); a group is one series. Series shorter than two periods have no season."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(t)
        y = rows[value].to_numpy(float)
        if len(y) < 2 * period or np.isnan(y).any():
            m = np.full(len(y), np.nanmean(y) if np.isfinite(y).any() else 0.0)
            parts = (m, np.zeros(len(y)), y - m)
        else:
            parts = stl(y, period)
        return rows.assign(trend=parts[0], seasonal=parts[1], residual=parts[2])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in long.select(key, t, value).schema) + ", trend double, seasonal double, residual double"
    return long.select(key, t, value).groupBy(key).applyInPandas(run, schema)
