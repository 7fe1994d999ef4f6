"""Where does a payload come from? Exact and chunk-overlap matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandlore.functions.hashing import blob_id
from strandlore.operators.chunks import chunk_fingerprints


def payload_fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(F.col(key).alias("origin_id"), blob_id(text).alias("fingerprint")).distinct()


def exact_matches(probes: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    """Probe payloads whose fingerprint an indexed origin carries (confidence 1)."""
    left = probes.where(F.col(text).isNotNull()).select(F.col(key).alias("query_id"), blob_id(text).alias("fingerprint"))
    return left.join(payload_fingerprints(index, key, text), "fingerprint").select("query_id", "origin_id").distinct()


def overlap_counts(probes: DataFrame, index: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Distinct shared chunk fingerprints per (query, origin), and the query's chunk total.

    Both sides are made distinct before the join, so that a chunk repeated inside a document
    multiplies nothing.
    """
    probe_chunks = chunk_fingerprints(probes, key, text, size).withColumnRenamed(key, "query_id")
    totals = probe_chunks.groupBy("query_id").agg(F.count("*").alias("total_chunks"))
    asked = probe_chunks.select("query_id", "fingerprint").distinct()
    known = chunk_fingerprints(index, key, text, size).select(F.col(key).alias("origin_id"), "fingerprint").distinct()
    hits = asked.join(known, "fingerprint").groupBy("query_id", "origin_id").agg(F.count("*").alias("matched_chunks"))
    return hits.join(totals, "query_id")


def resolve(probes: DataFrame, index: DataFrame, key: str = "doc_id", text: str = "text", size: int = 256, cap: float = 0.95) -> DataFrame:
    """Candidates per query, ranked: exact ones first, then overlap ratio capped at ``cap``; exact origins are not repeated as overlaps."""
    exact = exact_matches(probes, index, key, text)
    partial = overlap_counts(probes, index, key, text, size).join(exact, ["query_id", "origin_id"], "left_anti")
    none = F.lit(None).cast("long")
    found = exact.select(
        "query_id", "origin_id", F.lit("exact").alias("match_kind"), none.alias("matched_chunks"), none.alias("total_chunks"), F.lit(1.0).alias("confidence")
    ).unionByName(
        partial.select(
            "query_id",
            "origin_id",
            F.lit("chunk_overlap").alias("match_kind"),
            "matched_chunks",
            "total_chunks",
            F.least(F.round(F.col("matched_chunks") / F.col("total_chunks"), 6), F.lit(cap)).alias("confidence"),
        )
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "origin_id")
    return found.withColumn("rank", F.row_number().over(w))


def word_grams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, h1, h2): distinct n-word grams of the lower-case text as two independent 64-bit hashes. No shuffle."""
    words = F.split(F.lower(F.trim(F.col(text))), r"\s+")
    rows = df.select(key, words.alias("w")).where(F.size("w") >= n)

    def hashed(i):
        gram = F.transform(F.array(F.array_join(F.slice(F.col("w"), i, F.lit(n)), " ")), lambda g: F.concat_ws(":", F.xxhash64(g), F.xxhash64(F.lit(1), g)))
        return gram[0]

    # strings are made distinct by hash, structs pair by pair
    grams = rows.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), hashed))).alias("g"))
    return grams.select(key, F.substring_index("g", ":", 1).cast("long").alias("h1"), F.substring_index("g", ":", -1).cast("long").alias("h2"))


def shared_grams(docs: DataFrame, passages: DataFrame, doc_key: str, passage_key: str, text: str, n: int = 13, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(passage, doc, shared_grams) of passages that documents share.

    Passages are few: up to a counted number of grams they are broadcast, so documents stay in their
    scan; beyond it both sides meet by hash. Grams travel as 16 bytes, never as text.
    """
    asked = word_grams(passages, passage_key, text, n)
    side = F.broadcast(asked) if asked.count() <= broadcast_rows else asked
    return word_grams(docs, doc_key, text, n).join(side, ["h1", "h2"]).groupBy(passage_key, doc_key).agg(F.count("*").alias("shared_grams"))
