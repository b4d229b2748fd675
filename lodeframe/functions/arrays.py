"""Column expressions over arrays of doubles; positions count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def variance(a: Column) -> Column:
    """Population variance."""
    return let(mean(a), lambda m: total(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a))


def znorm(a: Column, eps: float = 1e-8) -> Column:
    """(x - mean) / (population deviation + eps)."""
    return let(F.struct(mean(a).alias("m"), F.sqrt(variance(a)).alias("s")), lambda p: F.transform(a, lambda x: (x - p["m"]) / (p["s"] + eps)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def windows(a: Column, length: int, dilation: int = 1) -> Column:
    """All windows of ``length`` elements ``dilation`` apart; none if the array is too short."""
    last = F.size(a) - (length - 1) * dilation - 1
    if dilation == 1:
        cut = lambda i: F.slice(a, i + 1, length)
    else:
        cut = lambda i: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.get(a, (i + k * dilation).cast("int")))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), cut)).otherwise(F.array().cast("array<array<double>>"))


def paa(a: Column, segments: int) -> Column:
    """Means of ``segments`` equal parts; null where the length isn't a multiple."""
    width = (F.size(a) / segments).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: mean(F.slice(a, i * width + 1, width)))
    return F.when((F.size(a) > 0) & (F.size(a) % segments == 0), parts)


def slope(a: Column) -> Column:
    """Least-squares slope on position; 0 for fewer than two values."""
    n = F.size(a).cast("double")
    sxy = F.aggregate(F.transform(a, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    sx = n * (n - 1) / 2
    sxx = (n - 1) * n * (2 * n - 1) / 6
    den = n * sxx - sx * sx
    return F.when(den > 1e-6, (n * sxy - sx * total(a)) / den).otherwise(F.lit(0.0))


def crossings(a: Column) -> Column:
    """Crossings of the mean over n - 1; a value on the mean counts with the side it comes to."""
    def count(m: Column) -> Column:
        up = F.transform(a, lambda x: x > m)
        flips = F.zip_with(F.slice(up, 1, F.size(up) - 1), F.slice(up, 2, F.size(up) - 1), lambda p, q: (p != q).cast("double"))
        return total(flips) / (F.size(a) - 1)

    return F.when(F.size(a) > 1, let(mean(a), count)).otherwise(F.lit(0.0))


def above_mean(a: Column) -> Column:
    return let(mean(a), lambda m: F.size(F.filter(a, lambda x: x > m)) / F.size(a))


def histogram_quantile(a: Column, q: float, bins: int = 64) -> Column:
    """The middle of the first of ``bins`` equal bins at which the cumulated count reaches q * n.

    A constant array gives its value. This is the extractor's approximation, not an exact quantile.
    """
    def body(p: Column) -> Column:
        width = (p["hi"] - p["lo"]) / bins
        index = lambda x: F.least(F.lit(bins - 1), F.floor((x - p["lo"]) / width).cast("int"))
        sorted_bins = F.array_sort(F.transform(a, index))
        at = F.get(sorted_bins, (F.greatest(F.lit(1), F.ceil(F.lit(q) * F.size(a))) - 1).cast("int"))
        return F.when(p["hi"] <= p["lo"], p["lo"]).otherwise(p["lo"] + (at + 0.5) * width)

    return let(F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi")), body)
