"""Where queries and their SQL twins are kept."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def near(c, places: int):
    """Rounded, with halves up whatever the last bits: both engines agree on means of few decimals."""
    from pyspark.sql import functions as F

    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * float(10**places) + 0.5001) / float(10**places)


def near_sql(expr: str, places: int) -> str:
    return f"(floor(({expr}) * 1e{places} + 0.5001) / 1e{places})"
