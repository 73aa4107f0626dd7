"""Every registered query of the engine against its SQL oracle."""

import os

import duckdb
import pytest

from tessera.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows):
    show = lambda v: "~" if v is None or v != v else round(float(v), 6) if isinstance(v, float) or hasattr(v, "quantize") else v
    return sorted(tuple(str(show(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert plain(got.select(*[f"`{c}`" for c in columns]).collect()) == plain(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())
