"""Writers: strict inserts, layers, JSON lines, staged replacement, artifacts, masked payloads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandlore.functions.hashing import blob_id


class Conflict(ValueError):
    """A row to insert has a key that is taken."""


def insert_strict(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The new rows, after making sure that none of their keys is taken or repeated."""
    taken = new.join(existing.select(*key), key, "left_semi").select(*key)
    twice = new.groupBy(*key).count().where("count > 1").select(*key)
    first = taken.union(twice).first()
    if first is not None:
        raise Conflict(f"{', '.join(key)} = {tuple(first)} exists")
    return new


def write_layers(rows: DataFrame, layer: str, path: str) -> None:
    """One folder per layer; rows of a layer meet in few files."""
    rows.repartition(F.col(layer), F.pmod(F.xxhash64(*[c for c in rows.columns if c != layer]), F.lit(8))).write.mode("overwrite").partitionBy(layer).parquet(path)


def write_records(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("compression", "gzip").json(path)


def replace(rows: DataFrame, path: str) -> None:
    """The new table is written in full beside the old one, which is moved aside and goes last; a failure leaves one of them whole."""
    spark = rows.sparkSession
    jvm = spark._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(f"{path}.staged"), jvm.org.apache.hadoop.fs.Path(path)
    rows.write.mode("overwrite").parquet(f"{path}.staged")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.replaced")
    if fs.exists(old):
        fs.delete(aside, True)  # of an earlier call that was cut off after its own move
        if not fs.rename(old, aside):
            raise OSError(f"{path} could not be moved aside")
    if not fs.rename(new, old):
        if fs.exists(aside):
            fs.rename(aside, old)
        raise OSError(f"{path}.staged could not be moved into place")
    fs.delete(aside, True)


def artifacts(rows: DataFrame, name: Column, kind: Column, data: Column, level: int = 3) -> DataFrame:
    """(blob_id, name, artifact_type, size_raw, size_stored, stored): zstd frames, ids of the raw content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            stored = [pack.compress(d) for d in batch["data"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["blob_id"], batch["name"], batch["artifact_type"], batch["size_raw"], pa.array([len(s) for s in stored], pa.int64()), pa.array(stored, pa.binary())],
                names=["blob_id", "name", "artifact_type", "size_raw", "size_stored", "stored"],
            )

    binary = data.cast("binary")
    source = rows.select(blob_id(binary).alias("blob_id"), name.alias("name"), kind.alias("artifact_type"), F.octet_length(binary).cast("long").alias("size_raw"), binary.alias("data"))
    return source.mapInArrow(run, "blob_id string, name string, artifact_type string, size_raw long, size_stored long, stored binary")


def masked(data: Column, key: int = 0xA5) -> Column:
    """Every byte XORed with one key byte; masking twice gives the data back. A test double, not encryption."""
    bytes_as_chars = F.split(F.decode(data, "ISO-8859-1"), "")
    turned = F.encode(F.array_join(F.transform(bytes_as_chars, lambda c: F.chr(F.ascii(c).bitwiseXOR(key).cast("long"))), ""), "ISO-8859-1")
    return F.when(F.octet_length(data) == 0, data).otherwise(turned)
