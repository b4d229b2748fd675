"""Every registered query against its SQL twin in DuckDB, value by value; those without a twin give rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from lodeframe import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    r = con.execute(SQL[name])
    names = [d[0] for d in r.description]
    want = sorted(str([plain(dict(zip(names, x, strict=True))[c]) for c in cols]) for x in r.fetchall())
    assert sorted(names) == cols and got == want and got


SLOW = {n for n in QUERIES if n.startswith("model_")} | {"stacking", "stacking_classes", "resampling_benchmark", "trial_search", "imputer_search"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
