"""The interval feature extractor: representations x dilated windows x statistics x pooled parts, and raw points.

A feature is named ``ch{channel}_{representation}_{statistic}_{pool}`` with the length, dilation, level and part that it
comes from; level 0 pools whole series ("global"), deeper levels pool parts ("local"). Values are computed a batch of
series at a time, as matrices over all series and windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import burg, fisher, grid, partitions, select_top

STATS = ("mean", "std", "slope", "min", "max", "median", "iqr")
POOLS = ("mean", "min", "max", "std", "slope", "crossings")
REPRESENTATIONS = ("original", "periodogram", "derivative", "autoregressive")


@dataclass(frozen=True)
class Feature:
    representation: str
    statistic: str  # "raw" for a point of the representation itself
    pool: str
    length: int
    dilation: int
    level: int  # -1 for raw points
    part: int  # of the level, or the point

    def name(self, channel: int = 0) -> str:
        return f"ch{channel}_{self.representation}_{self.statistic}_{self.pool}"


def represent(x: np.ndarray, kind: str) -> np.ndarray:
    """One representation of series of one length, a row for each."""
    if kind == "original":
        return x
    if kind == "periodogram":
        return np.abs(np.fft.fft(x, axis=1))[:, : x.shape[1] // 2]
    if kind == "derivative":
        return np.diff(x, axis=1)
    if kind == "autoregressive":
        order = int(12 * (x.shape[1] / 100) ** 0.25)
        return np.array([burg(r, order) for r in x]).reshape(len(x), order)
    raise ValueError(kind)


def histogram_quantiles(a: np.ndarray, shares: tuple[float, ...], bins: int = 64) -> list[np.ndarray]:
    """Along the last axis: the middle of the first of ``bins`` equal bins at which the count reaches share * n."""
    low, high = a.min(axis=-1, keepdims=True), a.max(axis=-1, keepdims=True)
    width = (high - low) / bins
    safe = np.where(width > 0, width, 1.0)
    place = np.sort(np.minimum(bins - 1, np.floor((a - low) / safe)), axis=-1)
    at = lambda q: place[..., max(1, int(np.ceil(q * a.shape[-1]))) - 1]
    return [np.where(high[..., 0] > low[..., 0], low[..., 0] + (at(q) + 0.5) * width[..., 0], low[..., 0]) for q in shares]


def _slope(a: np.ndarray) -> np.ndarray:
    n = a.shape[-1]
    i = np.arange(n, dtype=float)
    den = n * (i * i).sum() - i.sum() ** 2
    return (n * (a @ i) - i.sum() * a.sum(axis=-1)) / den if den > 1e-6 else np.zeros(a.shape[:-1])


def _deviation(a: np.ndarray, least: float) -> np.ndarray:
    v = a.var(axis=-1)
    return np.sqrt(np.where(v > least, v, 0.0))


def _crossings(a: np.ndarray) -> np.ndarray:
    up = a > a.mean(axis=-1, keepdims=True)
    return (up[..., 1:] != up[..., :-1]).mean(axis=-1) if a.shape[-1] > 1 else np.zeros(a.shape[:-1])


KERNELS = {
    "mean": lambda a, _: a.mean(axis=-1), "min": lambda a, _: a.min(axis=-1), "max": lambda a, _: a.max(axis=-1), "std": _deviation, "slope": lambda a, _: _slope(a),
    "crossings": lambda a, _: _crossings(a), "above": lambda a, _: (a > a.mean(axis=-1, keepdims=True)).mean(axis=-1),
    "median": lambda a, _: histogram_quantiles(a, (0.5,))[0], "iqr": lambda a, _: np.subtract(*histogram_quantiles(a, (0.75, 0.25))),
}


def sample_operators(names: tuple[str, ...], n: int, level: int, part: int, seed: int = 42) -> tuple[str, ...]:
    """All operators at level 0; deeper, ``n`` of them drawn by md5 of seed, level, part and name, in their own order."""
    if level == 0 or n >= len(names):
        return tuple(names)
    drawn = sorted(names, key=lambda x: hashlib.md5(f"{seed}:{level}:{part}:{x}".encode()).hexdigest())[:n]
    return tuple(x for x in names if x in drawn)


def catalogue(n: int, levels: int = 3, pools: tuple[str, ...] = POOLS, sampled: int = 6, seed: int = 42) -> list[Feature]:
    """The features of a series of ``n`` values, in the order of ``extract``."""
    out = []
    for kind in REPRESENTATIONS:
        m = represent(np.zeros((1, n)), kind).shape[1]
        for length, dilation in grid(m):
            for stat in STATS:
                for level, part, a, b in partitions(m - (length - 1) * dilation, levels):
                    if b - a > 1:
                        out += [Feature(kind, stat, p, length, dilation, level, part) for p in sample_operators(pools, sampled, level, part, seed)]
        out += [Feature(kind, "raw", "raw", 0, 0, -1, i) for i in range(m)]
    return out


def matrix(x: np.ndarray, wanted: list[Feature], levels: int = 3) -> np.ndarray:
    """The features ``wanted`` of series of one length, a row for each series."""
    need: dict = {}
    for i, f in enumerate(wanted):
        need.setdefault(f.representation, {}).setdefault((f.length, f.dilation), {}).setdefault(f.statistic, []).append((i, f))
    out = np.empty((len(x), len(wanted)))
    for kind, shapes in need.items():
        r = represent(x, kind)
        for (length, dilation), stats in shapes.items():
            if not length:
                for i, f in stats["raw"]:
                    out[:, i] = r[:, f.part]
                continue
            w = np.lib.stride_tricks.sliding_window_view(r, (length - 1) * dilation + 1, axis=1)[:, :, ::dilation]
            parts = {(lv, p): (a, b) for lv, p, a, b in partitions(w.shape[1], levels)}
            for stat, features in stats.items():
                s = KERNELS[stat](w, 1e-14)
                for i, f in features:
                    a, b = parts[f.level, f.part]
                    out[:, i] = KERNELS[f.pool](s[:, a:b], 1e-6)
    return out


def extract(df: DataFrame, key: str, values: str, wanted: list[Feature], n: int, levels: int = 3, rows: int = 256) -> DataFrame:
    """(key, x): the features ``wanted`` of every series of ``n`` values; series of other lengths and with gaps have x null.

    Features that aren't wanted are never computed, so a test table needs no columns for what wasn't selected.
    """
    names = [key, "x"]
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, rows) for whole in batches for i in range(0, whole.num_rows, rows)):
            series = b.column(1).to_pylist()
            good = [i for i, v in enumerate(series) if v is not None and len(v) == n and None not in v]
            x: list = [None] * len(series)
            if good:
                for i, row in zip(good, matrix(np.array([series[i] for i in good], float), wanted, levels).tolist(), strict=True):
                    x[i] = row
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names)

    return df.select(key, values).mapInArrow(run, f"`{key}` {kind.simpleString()}, x array<double>")


def choose(train: DataFrame, key: str, values: str, label: str, n: int, share: float = 0.4, levels: int = 3, **how) -> list[Feature]:
    """The features to use: all global ones, and of the local ones and raw points the ``share`` of greatest Fisher score.

    Scores are an aggregation by feature; a row for each feature reaches the driver.
    """
    every = catalogue(n, levels, **how)
    some = [i for i, f in enumerate(every) if f.level != 0]
    x = extract(train, key, values, [every[i] for i in some], n, levels).join(train.select(key, label), key)
    long = x.select(label, F.posexplode("x").alias("f", "value"))
    top = {r["f"] for r in select_top(fisher(long, label, "f"), share, "f").select("f").collect()}
    chosen = {some[i] for i in top}
    return [f for i, f in enumerate(every) if f.level == 0 or i in chosen]


def fuse(channels: list[DataFrame], key: str) -> DataFrame:
    """(key, x): the features of all channels of a subject one after the other, for subjects in every channel."""
    out = channels[0].select(key, F.col("x").alias("_0"))
    for i, c in enumerate(channels[1:], 1):
        out = out.join(c.select(key, F.col("x").alias(f"_{i}")), key)
    return out.select(key, F.concat(*[f"_{i}" for i in range(len(channels))]).alias("x"))


def feature_names(channels: list[list[Feature]]) -> list[str]:
    """A name for each column that ``fuse`` makes of the channels' features."""
    return [f.name(c) for c, features in enumerate(channels) for f in features]
