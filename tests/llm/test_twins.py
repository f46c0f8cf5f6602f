"""Queries that SQL can express against their twins, over whole small tables."""

import os

import duckdb
import pytest

from tremolite.llm.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(DIR, t)}.parquet'")
    got = QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    want = sorted(repr(r) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())
    assert sorted(repr(tuple(r)) for r in got.select(*cols).collect()) == want
