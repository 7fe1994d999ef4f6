import pytest
from pyspark.sql import functions as F

from strandlore.operators import clusters as C, vectors as V
from strandlore.sources import sinks


def test_insert_strict(spark):
    old, new = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(3,)], "k int")
    assert sinks.insert_strict(old, new, ["k"]).count() == 1
    for bad in ([(2,)], [(4,), (4,)]):
        with pytest.raises(sinks.Conflict):
            sinks.insert_strict(old, spark.createDataFrame(bad, "k int"), ["k"])


def test_layers_records_replace(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"layer{i % 3}", "t" * i) for i in range(30)], "id int, layer string, text string")
    sinks.write_layers(rows, "layer", str(tmp_path / "layers"))
    assert spark.read.parquet(str(tmp_path / "layers")).where("layer = 'layer1'").count() == 10
    sinks.write_records(rows, str(tmp_path / "lines"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "lines")).exceptAll(rows).count() == 0
    for n in (5, 7):
        sinks.replace(rows.where(F.col("id") < n), str(tmp_path / "table"))
        assert spark.read.parquet(str(tmp_path / "table")).count() == n
    assert not (tmp_path / "table.staged").exists()


def test_masking_twice_is_nothing(spark):
    df = spark.createDataFrame([(bytearray(range(256)),), (bytearray(),)], "b binary")
    for r in df.select("b", sinks.masked(F.col("b")).alias("m"), sinks.masked(sinks.masked(F.col("b"))).alias("again")).collect():
        assert r.again == r.b and (not r.b or r.m == bytearray(x ^ 0xA5 for x in r.b))


def test_artifacts_dedupe_by_content(spark):
    out = sinks.artifacts(spark.createDataFrame([("a", "x" * 999), ("b", "x" * 999)], "n string, t string"), F.col("n"), F.lit("json"), F.col("t")).collect()
    assert out[0].blob_id == out[1].blob_id and out[0].size_stored < 60


def test_adapt_splits_far_and_merges_alike(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    points = [rng.normal(0, 0.08, 4) for _ in range(300)] + [rng.normal(5, 0.08, 4) for _ in range(20)] + [rng.normal(-5, 0.08, 4) for _ in range(20)]
    rows = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, v array<double>")
    centres, placed = C.adapt(rows, "id", "v", 3, split_ratio=2.0)
    assert centres.count() > 3 and placed.count() == 340
    alike = spark.createDataFrame([(i, [float(5 * (i % 4) + 0.01 * (i // 4))]) for i in range(64)], "id long, v array<double>")
    assert C.adapt(alike, "id", "v", 4, merge_ratio=1.5, steps=1)[0].count() <= 4


def test_silhouette_and_compact(spark):
    rows = spark.createDataFrame([(i, i % 2, [10.0 * (i % 2) + 0.01 * i, 0.0]) for i in range(40)], "id long, c int, v array<double>")
    assert C.silhouette(rows, "id", "c", "v") > 0.9
    assert C.silhouette(rows.where("c = 0"), "id", "c", "v") is None
    members = C.build(rows, V.centroids(rows, "c", "v"), "id", "c", "v")
    assert all(len(r.codes) == 2 and r.scale > 0 for r in C.compact(members, "c", "id").collect())


def test_replace_swaps_tables(spark, tmp_path):
    path = str(tmp_path / "table")
    for n in (3, 5):
        sinks.replace(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert sorted(p.name for p in tmp_path.iterdir()) == ["table"]


def test_split_and_merge_follow_the_shape(spark):
    """A cluster of two far halves is split between them; of clusters alike the smallest goes to its neighbour."""
    rows = spark.createDataFrame([(i, [float(10 * (i % 2)), 0.1 * (i % 7)]) for i in range(200)], "id long, v array<double>")
    centres, sides = C.split(rows, "id", "v", [5.0, 0.3])
    of = {r.id: r.nearest for r in sides.collect()}
    assert {of[i] for i in of if i % 2} != {of[i] for i in of if i % 2 == 0} and len(set(of.values())) == 2 and sorted(round(c[0]) for c in centres) == [0, 10]
    assert C.split(rows.where("id % 14 = 0"), "id", "v", [0.0, 0.0]) is None
    alike = spark.createDataFrame([(i, [float(5 * (i % 3))]) for i in range(30)], "id long, v array<double>")
    centres, placed = C.adapt(alike, "id", "v", merge_ratio=1.5, steps=1)
    assert centres.count() <= round(30**0.5) and placed.count() == 30
