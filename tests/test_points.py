"""Nearest points by cells: equal to SQL and to brute force on odd rows, without meeting all rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlore.operators import points
from strandlore.plans import registry


def apart(a, b):
    return F.when(a["kind"] == b["kind"], 0).otherwise(50) + sum(F.abs(a[c] - b[c]) for c in "xyz")


def squared(a, b):
    return F.when(a["kind"] == b["kind"], 0).otherwise(50) + sum((a[c] - b[c]) * (a[c] - b[c]) for c in "xyz")


def framed(spark, rows):
    return spark.createDataFrame(rows, "item_id long, kind int, x int, y int, z int").select("item_id", F.struct("kind", "x", "y", "z").alias("p"))


@pytest.mark.parametrize("power,distance", [(1, apart), (2, squared)])
@pytest.mark.parametrize("n,few", [(600, 0), (4, 0), (4, 9)])
def test_nearest_equals_brute_force(spark, power, distance, n, few):
    rng = random.Random(n)
    place = lambda: (rng.choice([1, 1, 1, 2]), *rng.choice([(rng.randint(-8, 7),) * 3, (rng.randint(-64, 63), rng.randint(-3, 3), 5), (-64, 63, -64), (63, 63, 63)]))
    rows = [(i, *place()) for i in range(n)] + [(i, None, None, None, None) for i in range(n, n + few)] + [(0, *place())] * 2 + [(None, *place())]
    want = []
    for q in (r for r in rows if r[0] is not None and r[0] % 3 == 0):
        for r in rows:
            known = q[1] is not None and r[1] is not None
            d = 50 * (q[1] != r[1]) + sum(abs(a - b) ** power for a, b in zip(q[2:], r[2:], strict=True)) if known else None
            want.append((q[0], d, r[0]))
    last = lambda v: (v is None, v)
    by: dict = {}
    for q, d, i in sorted(want, key=lambda t: (t[0], last(t[1]), last(t[2]))):
        by.setdefault(q, []).append((i, d))
    got = points.nearest(framed(spark, rows), F.col("item_id") % 3 == 0, 5, distance, ["x", "y", "z"], "kind", -64, 7, power)
    found = sorted((r.query_id, r["rank"], r.item_id, r.distance) for r in got.collect())
    assert found == [(q, k + 1, *x) for q in sorted(by) for k, x in enumerate(by[q][:5])]


def test_nearest_meets_few_rows(spark):
    met = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(d):
        met.add(1)
        return d

    rng = random.Random(5)
    rows = [(i, 1, rng.randint(0, 255), rng.randint(0, 255), rng.randint(0, 20)) for i in range(8000)] + [(i, 1, 9, 9, 9) for i in range(8000, 12000)]
    got = points.nearest(framed(spark, rows), F.col("item_id") % 100 == 0, 5, lambda a, b: counted(squared(a, b)), ["x", "y", "z"], "kind", 0, 8, 2)
    assert got.count() == 600 and 0 < met.value < 0.05 * 120 * 12000


@pytest.mark.parametrize("name", ["color_nearest", "lattice_nearest"])
@pytest.mark.parametrize("n", [3, 300])
def test_nearest_texts_equal_oracle(spark, tmp_path, name, n):
    rng = random.Random(n)
    texts = [None, "", "one", "def f(): import os class return {x}", *["a copy of a text"] * 200]
    rows = [(i, None if i % 2 else "tail") if n == 3 else (i, rng.choice(texts) if i % 3 else " ".join(rng.choices("ab cd efg theorem = 12 x".split(), k=i % 40))) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
