"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has SLOTS positions. Every shard stands at VNODES of them; a document's slot comes from a
hash of its doc_id, and it belongs to the first shard clockwise that isn't full. All documents of a
slot see the shards in the same order, so who overflows can be decided on the counts of the slots
alone: SLOTS numbers, a fixed bound, on the driver. A slot's documents, in hash order, then take the
places that its quota gives them.

Law ``rows``: a shard's load is bounded by its part of the row count, rounded up for the first
``rows mod shards`` shards, so counts are at most one apart. Few documents leave the shard that a
plain ring would give them, and those go to the next one clockwise.

Defined cases: null text has 8 bytes and the CRC of nothing (0); null and repeated doc_ids hash
like any other value; equal rows take neighbouring places; texts of any length count by their bytes; only doc_id and the
text are read, whatever other columns are called; an empty table gives an empty table.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from strandlore.session import cut

SLOTS, VNODES = 8192, 64


def ring(shards: int, slots: int = SLOTS, vnodes: int = VNODES) -> list[list[int]]:
    """For each slot the shards in clockwise order, each once."""
    at: list[list[int]] = [[] for _ in range(slots)]
    for shard in range(shards):
        for v in range(vnodes):
            at[xxhash.xxh64_intdigest(f"{shard}:{v}", 42) % slots].append(shard)
    order: list[list[int]] = [[]] * slots
    ahead: list[int] = []
    for step in range(2 * slots - 1, -1, -1):  # twice round, so that the first pass knows what lies beyond the seam
        here = list(dict.fromkeys(at[step % slots]))
        if here:
            ahead = here + [s for s in ahead if s not in here]
        order[step % slots] = ahead
    return order


def quotas(counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(slot, first rank, end rank, shard, place of the first) from the rows of each slot."""
    order, total = ring(shards), sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    left, placed, filled = dict(counts), {k: 0 for k in counts}, [0] * shards
    out = []
    for depth in range(shards):
        for slot in sorted(left):
            shard = order[slot][depth]
            n = min(left[slot], room[shard])
            if n:
                out.append((slot, placed[slot], placed[slot] + n, shard, filled[shard]))
                placed[slot] += n
                left[slot] -= n
                filled[shard] += n
                room[shard] -= n
    return out


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    spark = docs.sparkSession
    rows = cut(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64("doc_id").alias("_h"),
        ).withColumn("_slot", F.pmod("_h", F.lit(SLOTS)).cast("int"))
    )
    counts = {r["_slot"]: r["count"] for r in rows.groupBy("_slot").count().collect()}  # SLOTS rows at most
    plan = spark.createDataFrame(quotas(counts, shards) or [(-1, 0, 0, 0, 0)], "_slot int, _from long, _to long, shard int, _first long")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_slot").orderBy("_h", "doc_id", "text_crc32", "size")) - 1)
    within = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(plan), "_slot").where(within).select(  # at most SLOTS * shards rows
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_first") + F.col("_rank") - F.col("_from")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
