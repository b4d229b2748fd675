"""Preparing features: scaling, filling and axes fitted on one table and applied to any."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .impute import _moments
from .ranks import quantiles


@dataclass(frozen=True)
class Chain:
    """Population scaling, then filling with the scaled median or mean, then, if asked for, principal axes."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    deviation: tuple[float, ...]
    filling: tuple[float, ...]
    centre: tuple[float, ...] = ()
    axes: tuple[tuple[float, ...], ...] = ()

    def scaled(self) -> list[Column]:
        out = []
        for c, m, s, v in zip(self.columns, self.mean, self.deviation, self.filling, strict=True):
            z = (F.col(f"`{c}`").cast("double") - m) / s if s > 0 else F.when(F.col(f"`{c}`").isNotNull(), F.lit(0.0))
            out.append(F.coalesce(z, F.lit(v)))
        return out

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        """(key, x) of every row of ``df``, by what was learnt from the table that the chain was fitted on."""
        x = self.scaled()
        if self.axes:
            x = [sum(((z - m) * a for z, m, a in zip(x, self.centre, axis, strict=True)), F.lit(0.0)) for axis in self.axes]
        return df.select(key, F.array(*x).alias("x"))


def fit(df: DataFrame, columns: list[str], how: str = "median", axes: int | None = None) -> Chain:
    """A chain of ``df``; missing cells have no part in its means. A column without values is 0. A few numbers for each column are collected."""
    row = df.agg(*[f(F.col(f"`{c}`").cast("double")) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    mean = [float(row[2 * i] or 0.0) for i in range(len(columns))]
    dev = [float(row[2 * i + 1] or 0.0) for i in range(len(columns))]
    filling = [0.0] * len(columns)
    if how == "median":
        med = {r["column"]: r["value"] for r in quantiles(df, {c: F.col(f"`{c}`") for c in columns}, [0.5]).collect()}
        filling = [(med[c] - m) / s if med.get(c) is not None and s > 0 else 0.0 for c, m, s in zip(columns, mean, dev, strict=True)]
    chain = Chain(tuple(columns), tuple(mean), tuple(dev), tuple(filling))
    if axes is None:
        return chain
    names = [f"_z{i}" for i in range(len(columns))]
    n, s, g = _moments(df.select(*[z.alias(k) for z, k in zip(chain.scaled(), names, strict=True)]), names)
    m = s / max(n, 1.0)
    turned = np.linalg.eigh(g - n * np.outer(m, m))[1][:, ::-1][:, :axes]
    turned = turned * np.sign(turned[np.abs(turned).argmax(axis=0), np.arange(turned.shape[1])])
    return Chain(*(getattr(chain, k) for k in ("columns", "mean", "deviation", "filling")), tuple(m.tolist()), tuple(map(tuple, turned.T.tolist())))
