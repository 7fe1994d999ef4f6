import duckdb
import pytest

from strandlore.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in got.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, [tuple(r) for r in df.select(*columns).collect()])) == sorted(map(repr, got.fetchall()))
