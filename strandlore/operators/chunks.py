"""Fixed-size chunking, manifests, validation and reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandlore.functions.hashing import blob_id


def fixed_chunks(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, ordinal, chunk_offset, chunk_length, chunk) per chunk of ``size`` code points; an empty text gives one empty chunk.

    Null texts give no chunk. A narrow generate: no shuffle.
    """
    last = F.greatest(F.ceil(F.length(text) / F.lit(size)).cast("int") - 1, F.lit(0))
    cut = df.select(key, F.col(text).alias("_text"), F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    chunk = F.col("_text").substr(F.col("ordinal") * size + 1, F.lit(size))
    return cut.where(F.col("_text").isNotNull()).select(
        key,
        "ordinal",
        (F.col("ordinal").cast("long") * size).alias("chunk_offset"),
        F.length(chunk).cast("long").alias("chunk_length"),
        chunk.alias("chunk"),
    )


def chunk_fingerprints(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    return fixed_chunks(df, key, text, size).withColumn("fingerprint", blob_id("chunk")).drop("chunk")


def manifest_validity(chunks: DataFrame, manifests: DataFrame, key: str, supported_version: int = 1) -> DataFrame:
    """Version, chunk count, total and offset contiguity per manifest.

    ``chunks``: key, ordinal, chunk_offset, chunk_length; ``manifests``: key, version, total_size, chunk_count.
    """
    w = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    facts = (
        chunks.withColumn("_expected", F.coalesce(F.sum("chunk_length").over(w), F.lit(0)))
        .groupBy(key)
        .agg(
            F.count("*").alias("n"),
            F.sum("chunk_length").alias("total"),
            F.bool_and(F.col("_expected") == F.col("chunk_offset")).alias("contiguous"),
        )
    )
    return manifests.join(facts, key, "left").select(
        key,
        (F.col("version") == supported_version).alias("version_ok"),
        (F.coalesce("n", F.lit(0)) == F.col("chunk_count")).alias("count_ok"),
        (F.coalesce("total", F.lit(0)) == F.col("total_size")).alias("total_ok"),
        F.coalesce("contiguous", F.lit(True)).alias("contiguous_ok"),
    )


def reassemble(chunks: DataFrame, key: str) -> DataFrame:
    """Chunks in order, joined again; one row per key."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "chunk")))
    return chunks.groupBy(key).agg(F.array_join(F.transform(ordered, lambda c: c["chunk"]), "").alias("payload"))


def reassemble_checked(chunks: DataFrame, key: str) -> DataFrame:
    """(key, payload, intact): chunks with ``blob_id`` and ``chunk_length`` are held against both, offsets must join;
    a payload with a chunk that fails is null."""
    sound = (blob_id("chunk") == F.col("blob_id")) & (F.length("chunk") == F.col("chunk_length"))
    rows = chunks.withColumn("_sound", sound)
    facts = F.bool_and("_sound") & (F.sum("chunk_length") == F.max(F.col("chunk_offset") + F.col("chunk_length")))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "chunk")))
    whole = rows.groupBy(key).agg(facts.alias("intact"), F.array_join(F.transform(ordered, lambda c: c["chunk"]), "").alias("payload"))
    return whole.select(key, F.when(F.col("intact"), F.col("payload")).alias("payload"), "intact")


def inline_or_chunked(length: Column, threshold: int = 256 * 1024) -> Column:
    return F.when(length <= threshold, "inline").otherwise("chunked")
