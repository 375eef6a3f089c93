"""Every structural query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from foldline.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def tidy(value):
    return (None if math.isnan(value) else value + 0.0) if isinstance(value, float) else value


def compare(found, name, sf):
    """The rows of found are those of the query's SQL over the tables in sf."""
    duck = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    columns = sorted(found.columns)
    got = sorted((tuple(tidy(r[c]) for c in columns) for r in found.collect()), key=repr)
    made = duck.execute(ORACLES[name])
    at = {d[0]: k for k, d in enumerate(made.description)}
    assert sorted(at) == columns and got
    assert got == sorted((tuple(tidy(r[at[c]]) for c in columns) for r in made.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, SF)
    if name in ORACLES:
        compare(found, name, SF)
    else:
        assert found.collect()
