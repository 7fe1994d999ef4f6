"""Every registered query of the library equals its DuckDB oracle."""

import duckdb
import pytest

from strandlore.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows):
    def one(v):
        if isinstance(v, float):
            return round(v, 9) + 0.0
        if isinstance(v, (list, tuple)):
            return tuple(one(x) for x in v)
        return v.isoformat() if hasattr(v, "isoformat") else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_oracle(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = norm(got.fetchall())
    assert norm([tuple(r) for r in df.select(*columns).collect()]) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs_without_oracle(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
