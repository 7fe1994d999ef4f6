"""Validation, sniffing, key unions, prefetch, batch statistics, cluster upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlore.operators import clusters as C, codecs, vectors as V
from strandlore.plans.base import Registry
from strandlore.sources import sinks

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_MEANS = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), x AS (SELECT label, i, avg(v[i]) AS m FROM e, unnest(range(1, 65)) AS u(i) GROUP BY 1, 2)"""


@R.add("SELECT event_id, true AS is_manifest FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, false FROM events WHERE event_id % 3 = 0")
def manifest_sniff(t):
    """Is a blob a chunk manifest, or plain bytes that only look like text?"""
    manifest = F.concat(F.lit('{"version":1,"total_size":'), F.col("event_id"), F.lit(',"chunk_count":0,"chunks":[]}'))
    blob = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(manifest)
    parsed = F.from_json(blob, "version int, total_size long, chunk_count int, chunks array<struct<blob_id:string>>")
    return t.events.select("event_id", F.coalesce(parsed["version"].isNotNull() & parsed["chunks"].isNotNull(), F.lit(False)).alias("is_manifest"))


@R.add("""SELECT l_returnflag, l_linestatus FROM lineitem WHERE year(l_shipdate) = 1996 UNION SELECT l_returnflag, l_linestatus FROM lineitem WHERE year(l_shipdate) = 1997""")
def metric_key_union(t):
    keys = lambda y: t.lineitem.where(F.year("l_shipdate") == y).select("l_returnflag", "l_linestatus")
    return keys(1996).union(keys(1997)).distinct()


@R.add("SELECT s_suppkey, sha256('[' || s_suppkey || ',' || s_nationkey || ']') AS layout FROM supplier")
def layout_fingerprint(t):
    return t.supplier.select("s_suppkey", F.sha2(F.to_json(F.array(F.col("s_suppkey"), F.col("s_nationkey").cast("long"))), 256).alias("layout"))


@R.add("""WITH m AS (SELECT max(event_id) / 2 AS middle FROM events), c AS (SELECT DISTINCT user_id FROM events, m WHERE event_id < middle)
SELECT DISTINCT user_id FROM events, m WHERE event_id >= middle AND user_id NOT IN (SELECT user_id FROM c WHERE user_id IS NOT NULL)""")
def prefetch_missing(t):
    """What the second half of the log needs and the first didn't bring in."""
    e = t.events.join(F.broadcast(t.events.agg((F.max("event_id") / 2).alias("middle"))))  # one row
    cached, ahead = e.where("event_id < middle"), e.where("event_id >= middle")
    return ahead.select("user_id").distinct().join(cached.select("user_id").distinct(), "user_id", "left_anti")


@R.add("""SELECT conv_id, turn, trim(role) <> '' AS role_ok, turn >= 0 AS turn_ok, trim(text) <> '' AS text_ok FROM conversations""")
def schema_validation(t):
    filled = lambda c: F.trim(F.col(c)) != ""
    return t.conversations.select("conv_id", "turn", filled("role").alias("role_ok"), (F.col("turn") >= 0).alias("turn_ok"), filled("text").alias("text_ok"))


@R.add("SELECT lang, count(*) AS items, sum(strlen(text))::BIGINT AS raw_bytes, round(1 - sum(n_chars) / greatest(sum(strlen(text)), 1), 6) AS saved FROM documents GROUP BY 1")
def batch_stats(t):
    raw = F.sum(F.octet_length("text"))
    return t.documents.groupBy("lang").agg(F.count("*").alias("items"), raw.alias("raw_bytes"), F.round(1 - F.sum("n_chars") / F.greatest(raw, F.lit(1)), 6).alias("saved"))


@R.add(f"WITH {_MEANS} SELECT e.label, vec_id, round(sqrt(sum((v[i] - m) * (v[i] - m))), 6) AS offset_norm, true AS restored FROM e JOIN x USING (label) GROUP BY 1, 2")
def cluster_build(t):
    centres = V.centroids(t.embeddings, "label", "embedding")
    members = C.build(t.embeddings, centres, "vec_id", "label", "embedding")
    whole = C.restore(members, centres, "label").join(t.embeddings.select("vec_id", "embedding"), "vec_id")
    near = F.forall(F.zip_with("restored", V.wide("embedding"), lambda a, b: F.abs(a - b) < 1e-9), lambda ok: ok)
    return whole.select("label", "vec_id", F.round(V.norm(F.col("offset")), 6).alias("offset_norm"), near.alias("restored"))


@R.add("SELECT page_id, sha256(url) AS restored, url <> '' AS differs FROM pages")
def masked_round_trip(t):
    hidden = sinks.masked(F.encode("url", "UTF-8"))
    return t.pages.select("page_id", F.sha2(sinks.masked(hidden), 256).alias("restored"), (hidden != F.encode("url", "UTF-8")).alias("differs"))


@R.add("SELECT 'sha256:' || sha256(text) AS blob_id, 'doc-' || doc_id AS name, lang AS artifact_type, strlen(text) AS size_raw FROM documents")
def artifact_store(t):
    return sinks.artifacts(t.documents, F.concat(F.lit("doc-"), "doc_id"), F.col("lang"), F.col("text")).drop("stored", "size_stored")


@R.add("SELECT doc_id, doc_id % 4 = 1 AND lang = 'en' AS allowed FROM documents")
def share_flags(t):
    """Policy flags that shares carry, as a predicate."""
    flags = F.struct((F.col("doc_id") % 4 == 1).alias("allow_reshare"), (F.col("lang") == "en").alias("allow_derivation"))
    return t.documents.select("doc_id", flags.alias("f")).select("doc_id", (F.col("f.allow_reshare") & F.col("f.allow_derivation")).alias("allowed"))


@R.add()
def compact_clusters(t):
    centres = V.centroids(t.embeddings, "label", "embedding")
    return C.compact(C.build(t.embeddings, centres, "vec_id", "label", "embedding"), "label", "vec_id")


@R.add()
def cluster_silhouette(t):
    return t.spark.createDataFrame([(C.silhouette(t.embeddings, "vec_id", "label", "embedding"),)], "silhouette double")


@R.add()
def adaptive_clusters(t):
    return C.adapt(t.embeddings, "vec_id", "embedding", 6)[1]


@R.add()
def sampled_clusters(t):
    return C.fit_on_sample(t.embeddings, "vec_id", "embedding", 6, 200, 5)[1]


@R.add()
def memory_recall(t):
    return C.recall_memory(t.conversations.withColumn("id", F.concat_ws(":", "conv_id", "turn")), "id", "text", "the first question", 10)


@R.add()
def blake3_ids(t):
    from strandlore.functions.blake3 import blake3_id

    return t.pages.select("page_id", blake3_id("url").alias("blob_id"))


@R.add()
def polar_stats(t):
    """One row: vectors, stored bytes, ratio to 32-bit floats, mean relative error."""
    coded = codecs.polar_quantise(t.embeddings, "vec_id", "embedding")
    stored = F.sum(F.octet_length("angles") + 1)
    return coded.agg(F.count("*").alias("vectors"), stored.alias("stored_bytes"), F.round(F.sum((F.octet_length("angles") + 1) * 4) / stored, 4).alias("ratio"), F.avg("relative_error").alias("mean_error"))
