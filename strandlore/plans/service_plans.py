"""Upload, sharing, origin resolution and registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlore.operators import ingest as I
from strandlore.plans.base import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _uploaded(t):
    return I.ingest(t.documents, "doc_id", "text", "source", F.lit("2024-01-01").cast("timestamp"), 1000)


@R.add("""WITH c AS (SELECT doc_id, substr(text, CAST(g * 1000 + 1 AS BIGINT), 1000) AS chunk FROM documents, unnest(range(0, greatest(CAST(ceil(length(text) / 1000.0) AS BIGINT), 1))) AS u(g))
SELECT 'origins' AS table_name, count(*) AS n FROM documents UNION ALL SELECT 'policies', count(*) FROM documents UNION ALL SELECT 'blobs', count(DISTINCT text) FROM documents
UNION ALL SELECT 'chunks', count(*) FROM c UNION ALL SELECT 'ref_events', 2 * (SELECT count(*) FROM documents) + (SELECT count(*) FROM (SELECT DISTINCT doc_id, chunk FROM c))
UNION ALL SELECT 'edges', count(*) FROM documents UNION ALL SELECT 'payload_fp', count(*) FROM documents UNION ALL SELECT 'chunk_fp', count(*) FROM (SELECT DISTINCT doc_id, chunk FROM c)""")
def upload_batch(t):
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name, df in _uploaded(t).items()]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


@R.add("""SELECT 'sha256:' || sha256(text) AS id, count(*)::BIGINT AS ref_count FROM documents GROUP BY 1""")
def upload_blob_refs(t):
    """References that uploads leave on whole-payload blobs (chunks have their own events)."""
    tables = _uploaded(t)
    whole = tables["origins"].select(F.col("blob_id").alias("id")).withColumn("delta", F.lit(1))
    return whole.groupBy("id").agg(F.sum("delta").alias("ref_count"))


@R.add("""WITH s AS (SELECT DISTINCT 'p' || (o_custkey % 50) AS principal, o_orderkey % 97 AS origin_id FROM orders WHERE o_orderstatus <> 'F' AND starts_with(o_orderpriority, '1'))
SELECT c_custkey, 'p' || (c_custkey % 50) AS principal, c_custkey % 97 AS origin_id FROM customer SEMI JOIN s ON s.principal = 'p' || (c_custkey % 50) AND s.origin_id = c_custkey % 97""")
def share_authorization(t):
    shares = t.orders.select(
        F.concat(F.lit("p"), F.col("o_custkey") % 50).alias("to"), (F.col("o_orderkey") % 97).alias("origin_id"), (F.col("o_orderstatus") == "F").alias("released"),
        F.when(F.col("o_orderpriority").startswith("1"), F.array(F.lit("read"), F.lit("derive"))).otherwise(F.array(F.lit("share"))).alias("caps"),
    )
    asked = t.customer.select("c_custkey", F.concat(F.lit("p"), F.col("c_custkey") % 50).alias("principal"), (F.col("c_custkey") % 97).alias("origin_id"))
    return I.readable(shares, asked).select("c_custkey", "principal", "origin_id")


@R.add("SELECT p_partkey, n IS NULL AS deletable FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey")
def blob_delete_guard(t):
    counts = t.lineitem.where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("ref_count"))
    return I.deletable(t.part.select("p_partkey"), counts, "p_partkey").select("p_partkey", "deletable")


@R.add("SELECT DISTINCT o_orderstatus, o_orderpriority, 'release:' || o_custkey AS share_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def release_once(t):
    """A share released twice counts once: the first release event of each."""
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.concat(F.lit("release:"), F.col("o_custkey")).alias("share_id"))
    return I.register(rows, ["share_id"], "o_orderkey").drop("o_orderkey").distinct()


@R.add("""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'ck-' || c_custkey ELSE '' END AS ck FROM customer), s AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'), m AS (SELECT DISTINCT o_custkey FROM orders)
SELECT c_custkey, CASE WHEN ck <> '' THEN ck WHEN s.o_custkey IS NOT NULL THEN 'rs-' || c_custkey WHEN m.o_custkey IS NOT NULL THEN 'mf-' || c_custkey ELSE sha256('new:' || c_custkey) END AS origin_id,
 CASE WHEN ck <> '' THEN 'checkpoint' WHEN s.o_custkey IS NOT NULL THEN 'resume' WHEN m.o_custkey IS NOT NULL THEN 'manifest' ELSE 'new' END AS resolved_by
FROM r LEFT JOIN s ON s.o_custkey = c_custkey LEFT JOIN m ON m.o_custkey = c_custkey""")
def resolve_origin(t):
    runs = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("ck-"), F.col("c_custkey"))).otherwise("").alias("checkpoint_origin"))
    known = lambda rows, p: rows.select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit(p), F.col("o_custkey")).alias("origin_id")).distinct()
    return I.resolve_origin(runs, known(t.orders.where("o_orderstatus = 'P'"), "rs-"), known(t.orders, "mf-"), "c_custkey")


@R.add("""WITH b AS (SELECT r_regionkey AS base_id, r_name AS model_name FROM region), a AS (SELECT 100 + n_nationkey AS adapter_id, n_regionkey AS base_id FROM nation),
 e AS (SELECT s_suppkey AS artifact_id, CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey % 5 ELSE 100 + s_nationkey END AS parent_id FROM supplier)
SELECT artifact_id, adapter_id, coalesce(a.base_id, e.parent_id)::INTEGER AS base_id, model_name FROM e LEFT JOIN a ON parent_id = adapter_id JOIN b ON b.base_id = coalesce(a.base_id, e.parent_id)""")
def model_lineage(t):
    bases = t.region.select(F.col("r_regionkey").alias("base_id"), F.col("r_name").alias("model_name"))
    adapters = t.nation.select((F.col("n_nationkey") + 100).alias("adapter_id"), F.col("n_regionkey").alias("base_id"))
    parent = F.when(F.col("s_suppkey") % 4 == 0, F.col("s_nationkey") % 5).otherwise(F.col("s_nationkey") + 100)
    return I.model_lineage(t.supplier.select(F.col("s_suppkey").alias("artifact_id"), parent.alias("parent_id")), adapters, bases)


@R.add("SELECT p_brand, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2")
def registry_first(t):
    return I.register(t.part.select("p_brand", "p_type", "p_partkey"), ["p_brand", "p_type"], "p_partkey")


@R.add("SELECT event_id, CASE WHEN lower(event_type) IN ('view', 'click') THEN lower(event_type) ELSE 'other' END AS kind FROM events")
def parse_enum(t):
    return t.events.select("event_id", I.parse_enum(F.concat(F.lit(" "), F.upper("event_type")), ["view", "click"], "other").alias("kind"))


@R.add("SELECT user_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE -1 END)::BIGINT AS delta FROM events GROUP BY 1")
def pin_release_deltas(t):
    return t.events.groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "view", 1).otherwise(-1)).alias("delta"))
