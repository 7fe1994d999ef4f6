import hashlib
import json

from pyspark.sql import functions as F

from strandlore.functions import hashing
from strandlore.sources import cas


def test_fanout_and_flat_stores(spark, tmp_path):
    for payload in (b"one", b"two", b"three"):
        h = hashlib.sha256(payload).hexdigest()
        folder = tmp_path / "cas" / "sha256" / h[:2]
        folder.mkdir(parents=True, exist_ok=True)
        (folder / h[2:]).write_bytes(payload)
        (tmp_path / "flat").mkdir(exist_ok=True)
        (tmp_path / "flat" / f"{h}.blob").write_bytes(payload)
    (tmp_path / "flat" / "notes.txt").write_text("x")
    rows = cas.read_fanout(spark, str(tmp_path / "cas"))
    assert rows.where(hashing.is_intact(F.col("blob_id"), F.col("data"))).count() == 3 == cas.blob_count(spark, str(tmp_path / "cas"))
    flat = cas.read_flat(spark, str(tmp_path / "flat"), "sha256")
    assert {r.blob_id for r in flat.collect()} == {r.blob_id for r in rows.collect()}


def test_put_is_idempotent(spark, tmp_path):
    payloads = spark.createDataFrame([("a",), ("b",), ("a",)], "t string").select(F.encode("t", "UTF-8").alias("p"))
    first = cas.put(None, payloads, F.col("p"))
    assert first.count() == 2
    cas.append(first, str(tmp_path / "blobs"))
    stored = spark.read.parquet(str(tmp_path / "blobs"))
    assert cas.put(stored, payloads, F.col("p")).count() == 0


def test_slices_join_again(spark):
    blobs = spark.createDataFrame([("x", bytearray(range(10))), ("y", bytearray())], "blob_id string, data binary")
    parts = {}
    for r in cas.slices(blobs, 4).orderBy("blob_id", "ordinal").collect():
        parts.setdefault(r.blob_id, []).append(bytes(r.part))
    assert parts == {"x": [bytes(range(4)), bytes(range(4, 8)), bytes([8, 9])], "y": [b""]}


def test_manifests_and_records(spark, tmp_path):
    doc = {"origin_id": "o", "artifacts": {"a1": {"blob_id": "b", "name": "n", "artifact_type": "json", "size_raw": 3}}}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "o.json").write_text(json.dumps(doc, indent=1))
    assert [tuple(r) for r in cas.read_manifests(spark, str(tmp_path / "m")).collect()] == [("o", "a1", "b", "n", "json", 3)]
    (tmp_path / "r.jsonl").write_text('{"chunk_id": "c", "quality_score": 0.5}\n')
    assert cas.read_records(spark, str(tmp_path / "r.jsonl"), "chunk_id string, quality_score double").first().quality_score == 0.5
