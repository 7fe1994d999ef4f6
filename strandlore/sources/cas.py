"""Content-addressed blobs on any file system that Spark reads, and the metadata beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandlore.functions.hashing import blob_id, canonical_blob_id

BLOBS = "blob_id string, data binary, size_bytes long"


def read_fanout(spark: SparkSession, root: str, with_data: bool = True) -> DataFrame:
    """Files at ``<root>/<alg>/<2 hex>/<rest>``; without data only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    parts = F.regexp_extract(F.col("path"), r"([^/]+)/([0-9a-f]{2})/([^/]+)$", 1), F.regexp_extract("path", r"([0-9a-f]{2})/([^/]+)$", 1), F.regexp_extract("path", r"([^/]+)$", 1)
    blob = F.concat(parts[0], F.lit(":"), parts[1], parts[2])
    columns = [blob.alias("blob_id"), F.col("length").alias("size_bytes")]
    return files.where(parts[0] != "").select(*columns, *([F.col("content").alias("data")] if with_data else []))


def read_flat(spark: SparkSession, root: str, default_alg: str = "blake3", with_data: bool = True) -> DataFrame:
    """Files named ``<hex>.blob``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.blob").option("recursiveFileLookup", True).load(root)
    columns = [canonical_blob_id(F.col("path"), default_alg).alias("blob_id"), F.col("length").alias("size_bytes")]
    return files.select(*columns, *([F.col("content").alias("data")] if with_data else []))


def blob_count(spark: SparkSession, root: str) -> int:
    """From the listing alone."""
    return read_fanout(spark, root, with_data=False).count()


def slices(blobs: DataFrame, size: int) -> DataFrame:
    """(blob_id, ordinal, part): sequential reads of ``size`` bytes."""
    n = F.greatest(F.ceil(F.octet_length("data") / F.lit(size)), F.lit(1)).cast("int")
    rows = blobs.select("blob_id", "data", F.explode(F.sequence(F.lit(0), n - 1)).alias("ordinal"))
    return rows.select("blob_id", "ordinal", F.substring("data", F.col("ordinal") * size + 1, F.lit(size)).alias("part"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; malformed lines fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_manifests(spark: SparkSession, path: str, schema: str = "origin_id string, artifacts map<string, struct<blob_id:string, name:string, artifact_type:string, size_raw:long>>") -> DataFrame:
    """One JSON document per file with a map of artifacts; a row per artifact."""
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return docs.select("origin_id", F.explode("artifacts").alias("artifact_id", "a")).select("origin_id", "artifact_id", "a.*")


def put(existing: DataFrame | None, payloads: DataFrame, data: Column) -> DataFrame:
    """Rows to append so that every payload is stored once: new ids only, each once."""
    new = payloads.select(blob_id(data).alias("blob_id"), data.alias("data"), F.octet_length(data).cast("long").alias("size_bytes"))
    if existing is not None:
        new = new.join(existing.select("blob_id"), "blob_id", "left_anti")
    return new.dropDuplicates(["blob_id"])


def append(rows: DataFrame, path: str) -> None:
    """Parquet append, clustered by id prefix so that lookups prune by statistics."""
    rows.sortWithinPartitions("blob_id").write.mode("append").option("compression", "zstd").parquet(path)
