"""Stores, records and slices, checked reassembly, proofs, repair steps, locality, and streams over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlore.functions import text as X
from strandlore.operators import chunks, history, replication, training as T
from strandlore.plans.base import Registry
from strandlore.plans.domain_plans import _AUDIT, _needs, _replicas
from strandlore.plans.text_plans import _LATTICE
from strandlore.session import shared_folder
from strandlore.sources import cas, sinks
from strandlore.streaming import operators as S

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("SELECT 'sha256:' || sha256(text) AS blob_id, strlen(text)::BIGINT AS size_bytes FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def store_put(t):
    """Two puts, of some payloads and then of all: each is stored once, and found by its id."""
    path = shared_folder(t.spark, "store")
    docs = t.documents.where("text is not null")
    cas.append(cas.put(None, docs.where("doc_id % 2 = 0"), F.col("text").cast("binary")), path)
    cas.append(cas.put(t.spark.read.parquet(path), docs, F.col("text").cast("binary")), path)
    return t.spark.read.schema(cas.BLOBS).parquet(path).select("blob_id", "size_bytes")


@R.add("SELECT conv_id, turn, role, text FROM conversations")
def records_read(t):
    path = shared_folder(t.spark, "records")
    sinks.write_records(t.conversations.select("conv_id", "turn", "role", "text"), path)
    return cas.read_records(t.spark, path, t.conversations.select("conv_id", "turn", "role", "text").schema.simpleString()[7:-1].replace(":", " "))


@R.add("""SELECT doc_id, g::INTEGER AS ordinal, least(700, strlen(text) - g * 700)::INTEGER AS part_bytes FROM documents, unnest(range(0, greatest(ceil(strlen(text) / 700.0)::BIGINT, 1))) AS u(g)""")
def blob_slices(t):
    blobs = t.documents.where("text is not null").select(F.col("doc_id").alias("blob_id"), F.col("text").cast("binary").alias("data"))
    return cas.slices(blobs, 700).select(F.col("blob_id").alias("doc_id"), "ordinal", F.octet_length("part").alias("part_bytes"))


@R.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 1")
def insert_strict(t):
    rows = t.orders.select("o_orderkey", "o_custkey")
    return sinks.insert_strict(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1"), ["o_orderkey"])


@R.add("SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN sha256(text) END AS payload_hash, doc_id % 10 <> 3 AS intact FROM documents WHERE text IS NOT NULL")
def checked_reassembly(t):
    """Chunks are verified by id and length before they are joined; a changed chunk fails its payload."""
    parts = chunks.fixed_chunks(t.documents, "doc_id", "text", 1000).withColumn("blob_id", F.concat(F.lit("sha256:"), F.sha2("chunk", 256)))
    damaged = parts.withColumn("chunk", F.when((F.col("doc_id") % 10 == 3) & (F.col("ordinal") == 0), F.concat(F.lit("~"), "chunk")).otherwise(F.col("chunk")))
    return chunks.reassemble_checked(damaged, "doc_id").select("doc_id", F.sha2("payload", 256).alias("payload_hash"), "intact")


@R.add("SELECT o_custkey, o_custkey % 7 <> 0 AS valid FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1")
def share_proof_check(t):
    """The digest that a share recorded against that of the edges before its cutoff; every seventh was tampered with."""
    edges = t.orders.withColumn("edge_id", F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    kind, cutoff = history.canonical_kind(F.lit("pin"), F.col("o_orderstatus")), F.col("o_orderdate") < "1998-01-01"
    shares = history.lineage_digest(edges, "o_custkey", "edge_id", kind, cutoff)
    shares = shares.select("o_custkey", F.when(F.col("o_custkey") % 7 == 0, F.lit("0" * 64)).otherwise(F.col("digest")).alias("proof"))
    return history.verify_proofs(shares, edges, "o_custkey", "edge_id", kind, cutoff)


@R.add(f"""WITH {_AUDIT}, src AS (SELECT blob_id, min(node_id) AS source_id FROM rep GROUP BY 1), ok AS (SELECT DISTINCT blob_id, node_id FROM rep WHERE state = 'healthy'),
 c AS (SELECT a.blob_id, a.missing, source_id, s_suppkey AS node_id, row_number() OVER (PARTITION BY a.blob_id ORDER BY s_suppkey) AS step
       FROM aud a JOIN src USING (blob_id) CROSS JOIN supplier WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.blob_id = a.blob_id AND ok.node_id = s_suppkey))
SELECT blob_id, source_id, node_id, step::INTEGER AS step FROM c WHERE step <= missing""")
def repair_steps(t):
    return replication.repair_steps(_needs(t), _replicas(t), t.supplier.select(F.col("s_suppkey").alias("node_id")))


@R.add("SELECT r_name AS region, s_suppkey AS node_id FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def nodes_by_region(t):
    places = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    return t.supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("region"), F.col("s_suppkey").alias("node_id"))


@R.add(f"""WITH {_LATTICE}, p AS (SELECT doc_id, layer::BIGINT * (1::BIGINT << 48) + (x + 32768)::BIGINT * (1::BIGINT << 32) + (y + 32768)::BIGINT * 65536 + (z + 32768) AS packed FROM lattice)
SELECT doc_id, packed, dense_rank() OVER (ORDER BY packed) - 1 AS place FROM p""")
def lattice_locality(t):
    """Points as one integer of 56 bits, and their places in its order."""
    points = t.documents.select("doc_id", X.lattice_packed(X.lattice(F.col("text"))).alias("packed"))
    return T.renumber(points, "packed").select("doc_id", "packed", F.col("new_cluster").cast("long").alias("place"))


def _streamed(t, rows, mode: str):
    """All that a stream over a table gives when it has read everything, through a file sink."""
    path = shared_folder(t.spark, "stream")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
    rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{path}/out").drop("batch")


def _event_stream(t):
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir) if not t.sf_dir.startswith("viewfs") else t.events


@R.add("SELECT user_id, count(*) AS access_count, min(ts) AS first_accessed_at, max(ts) AS last_accessed_at FROM events GROUP BY 1")
def stream_access_counters(t):
    out = _streamed(t, S.access_counters(_event_stream(t), "user_id", "ts"), "update")
    return out.select("user_id", "access_count", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_accessed_at", "last_accessed_at")])


@R.add("SELECT DISTINCT user_id, event_type FROM events")
def stream_idempotent_puts(t):
    """One micro-batch: a put of the same key again does nothing."""
    puts = _event_stream(t).select(F.struct("user_id", "event_type").alias("key"), "ts")
    return _streamed(t, S.idempotent_puts(puts, "key", "ts").select("key.user_id", "key.event_type"), "append")
