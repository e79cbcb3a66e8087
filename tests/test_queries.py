"""Every query of the base library against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os
from collections import Counter
from datetime import datetime

import duckdb
import pytest

from sparkdocket.queries import registry

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        return round(float(v), 5)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in registry.oracle_sql():
        assert rows
        return
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert rows == Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
