"""The registered queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from .registry import QUERIES, SQL


def _load() -> None:
    from . import features, kernels, metrics, models, outliers, patterns, series, tables  # noqa: F401  they register themselves


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(SQL)
