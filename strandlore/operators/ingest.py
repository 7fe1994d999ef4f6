"""Uploads as one batch, shares, pins, origins and the model registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandlore.functions.hashing import blob_id
from strandlore.operators.chunks import chunk_fingerprints

# Names that requests may use, by kind, and what others mean.
MEDIA = ["text", "image", "audio", "video", "model"]
DURABILITY = ["ephemeral", "durable"]


def parse_enum(value: Column, known: list[str], default: str) -> Column:
    """Any case; the default for what isn't known."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(known), low).otherwise(default)


def ingest(docs: DataFrame, key: str, text: str, owner: str, created_at: Column, chunk_size: int = 256) -> dict[str, DataFrame]:
    """Everything an upload records: origins, policies, blobs, chunks, reference events, edges and fingerprints.

    All tables are lazy and derive from the fingerprint of the text; ids are deterministic.
    """
    rows = docs.where(F.col(text).isNotNull())
    origin = F.sha2(F.concat(F.lit("origin:"), F.col(key).cast("string")), 256).alias("origin_id")
    blob = blob_id(text).alias("blob_id")
    size = F.octet_length(text).cast("long").alias("size_bytes")
    chunks = chunk_fingerprints(rows, key, text, chunk_size).withColumn("origin_id", F.sha2(F.concat(F.lit("origin:"), F.col(key).cast("string")), 256)).drop(key)
    durability = F.when(F.col(owner).isNull(), "ephemeral").otherwise("durable").alias("durability")
    origins = rows.select(origin, F.col(owner).alias("owner"), blob, size, created_at.alias("created_at"))
    fingerprints = chunks.select("fingerprint", "origin_id").distinct()
    return {
        "origins": origins,
        "policies": rows.select(origin, durability, F.when(F.col(owner).isNull(), 0).otherwise(1).alias("min_replicas")),
        "blobs": rows.select(blob, size).distinct(),
        "chunks": chunks,
        "ref_events": origins.select(F.lit("origin").alias("target_kind"), F.col("origin_id").alias("id"), F.lit(1).alias("delta")).union(
            origins.select(F.lit("blob"), "blob_id", F.lit(1)).union(fingerprints.select(F.lit("blob"), "fingerprint", F.lit(1)))
        ),
        "edges": origins.select(F.sha2(F.concat(F.lit("edge:"), "origin_id"), 256).alias("edge_id"), "origin_id", F.lit("origin_rep:original").alias("kind"), "created_at"),
        "payload_fp": origins.select(F.col("blob_id").alias("fingerprint"), "origin_id").distinct(),
        "chunk_fp": fingerprints,
    }


def readable(shares: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (principal, origin_id) that an unreleased share with the read capability allows."""
    open_ = shares.where(~F.col("released") & F.array_contains("caps", "read")).select(F.col("to").alias("principal"), "origin_id").distinct()
    return requests.join(open_, ["principal", "origin_id"], "left_semi")


def deletable(blobs: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """A blob may be deleted only when nothing refers to it."""
    return blobs.join(counts, key, "left").withColumn("deletable", F.coalesce("ref_count", F.lit(0)) == 0)


def resolve_origin(runs: DataFrame, resumes: DataFrame, manifests: DataFrame, key: str) -> DataFrame:
    """Origin per run by priority: what the checkpoint says, a resume record, the manifest, a new one."""
    joined = runs.join(resumes.select(key, F.col("origin_id").alias("_resume")), key, "left").join(manifests.select(key, F.col("origin_id").alias("_manifest")), key, "left")
    given = F.when(F.col("checkpoint_origin") != "", F.col("checkpoint_origin"))
    new = F.sha2(F.concat(F.lit("new:"), F.col(key).cast("string")), 256)
    how = F.when(given.isNotNull(), "checkpoint").when(F.col("_resume").isNotNull(), "resume").when(F.col("_manifest").isNotNull(), "manifest").otherwise("new")
    return joined.select(key, F.coalesce(given, "_resume", "_manifest", new).alias("origin_id"), how.alias("resolved_by"))


def register(rows: DataFrame, natural_key: list[str], seq: str) -> DataFrame:
    """Idempotent registration: the first record of a natural key is the one that counts."""
    w = Window.partitionBy(*natural_key).orderBy(seq)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def model_lineage(exports: DataFrame, adapters: DataFrame, bases: DataFrame) -> DataFrame:
    """(artifact, adapter, base): exports from adapters or straight from bases."""
    a = adapters.select(F.col("adapter_id"), F.col("base_id").alias("_base"))
    joined = exports.join(a, exports["parent_id"] == a["adapter_id"], "left").withColumn("base_id", F.coalesce("_base", "parent_id"))
    return joined.join(bases.select("base_id", "model_name"), "base_id").select("artifact_id", "adapter_id", "base_id", "model_name")
