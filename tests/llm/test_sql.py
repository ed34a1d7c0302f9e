"""Training-data queries against their SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from dwellspark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op11_slots", "op12_manifest"])
def test_query(spark, sf, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    out = duck.execute(ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    want = sorted(tuple(r[names.index(c)] for c in cols) for r in out.fetchall())
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.select(*cols).collect()), key=key) == sorted(want, key=key) and want
