"""Queries for training decisions, caches, clusters, traces and timestamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlore.operators import observability, training as T, vectors as V
from strandlore.plans.base import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_MEANS = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), x AS (SELECT label, i, avg(v[i]) AS m FROM e, unnest(range(1, 65)) AS u(i) GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS centroid FROM x GROUP BY 1)"""


@R.add("""WITH k AS (SELECT user_id, event_id, value FROM events WHERE event_id >= 20 AND event_id % 2 = 0), g AS (SELECT *, sum((value < 10)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS low FROM k),
 s AS (SELECT *, sum((value >= 10)::INT) OVER (PARTITION BY user_id, low ORDER BY event_id) AS streak FROM g) SELECT user_id, min(event_id) AS stop_step FROM s WHERE streak >= 3 GROUP BY 1""")
def convergence_stop(t):
    return T.first_stop(t.events, "user_id", "event_id", "value", 10.0, 3, 2, 20)


@R.add("""WITH l AS (SELECT l_suppkey, l_partkey AS layer, max(l_discount) AS sim FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY sim DESC, layer) AS n, count(*) OVER (PARTITION BY l_suppkey) AS total FROM l)
SELECT l_suppkey, layer, sim FROM r WHERE sim >= 0.05 AND n <= floor(total * 0.25)""")
def freeze_layers(t):
    layers = t.lineitem.groupBy("l_suppkey", F.col("l_partkey").alias("layer")).agg(F.max("l_discount").alias("sim"))
    return T.freeze(layers, "sim", 0.05, 0.25, "l_suppkey")


@R.add("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND event_id < (SELECT max(event_id) / 2 FROM events)), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND event_id >= (SELECT max(event_id) / 2 FROM events))
SELECT user_id, 'pin' AS action FROM b ANTI JOIN a USING (user_id) UNION ALL SELECT user_id, 'unpin' FROM a ANTI JOIN b USING (user_id)""")
def pin_window(t):
    """From the window of the first half's views to that of the second half's clicks."""
    e = t.events.join(F.broadcast(t.events.agg((F.max("event_id") / 2).alias("middle"))))  # one row
    return T.pin_window(e.where("event_type = 'view' and event_id < middle"), e.where("event_type = 'click' and event_id >= middle"), "user_id")


@R.add("""WITH e AS (SELECT event_type, user_id, count(*) AS uses, max(ts) AS last_use FROM events GROUP BY 1, 2), p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY uses DESC, last_use DESC, user_id) AS n FROM e ANTI JOIN p USING (user_id)) SELECT event_type, user_id FROM r WHERE n > 10""")
def shed_plan(t):
    entries = t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("uses"), F.max("ts").alias("last_use"))
    return T.shed(entries, t.events.where("event_type = 'purchase' and value > 100"), 10, "user_id", "event_type")


@R.add("SELECT count(*) AS entries, count(*) FILTER (event_type = 'error') AS dirty, count(*) FILTER (value > 50) AS pinned FROM events")
def cache_stats(t):
    return T.cache_stats(t.events.select((F.col("event_type") == "error").alias("dirty"), (F.col("value") > 50).alias("pinned")))


@R.add("""WITH f AS (SELECT user_id, event_type, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS flush FROM events),
 k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, event_type, flush ORDER BY event_id DESC) = 1)
SELECT user_id, event_type, flush::BIGINT AS flush, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY flush DESC) = 1 AS live FROM k""")
def write_back_plan(t):
    return T.flush_plan(t.events, ["user_id", "event_type"], "event_id", "event_id", 4)


@R.add("WITH k AS (SELECT l_partkey * 7 AS c FROM lineitem GROUP BY 1), n AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS new_cluster FROM k) SELECT c AS cluster, new_cluster FROM n")
def cluster_renumber(t):
    return T.renumber(t.lineitem.select((F.col("l_partkey") * 7).alias("cluster")).distinct(), "cluster").select("cluster", F.col("new_cluster").cast("long").alias("new_cluster"))


@R.add("""WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), r AS (SELECT label, n, max(n) OVER () / greatest(min(n) OVER (), 1) AS ratio, row_number() OVER (ORDER BY n DESC, label) AS d, row_number() OVER (ORDER BY n, label) AS u FROM s)
SELECT label, n, CASE WHEN ratio > 5 AND d = 1 THEN 'split' WHEN ratio < 1.5 AND u <= 2 THEN 'merge' ELSE 'keep' END AS action FROM r""")
def cluster_rebalance_plan(t):
    return T.rebalance_plan(t.embeddings.groupBy("label").agg(F.count("*").alias("n")), "label")


@R.add(f"""WITH {_MEANS}, d AS (SELECT e.label, list_sum(list_transform(range(1, 65), lambda i: (e.v[i] - c.centroid[i]) * (e.v[i] - c.centroid[i]))) AS d2 FROM e JOIN c USING (label))
SELECT label, count(*) AS n, round(avg(sqrt(d2)), 6) AS offset_mean, round(sqrt(max(d2)), 6) AS offset_max, round(sum(d2), 5) AS inertia FROM d GROUP BY 1""")
def cluster_offsets(t):
    out = T.offset_norms(t.embeddings, V.centroids(t.embeddings, "label", "embedding"), "label", "embedding")
    return out.select("label", "n", F.round("offset_mean", 6).alias("offset_mean"), F.round("offset_max", 6).alias("offset_max"), F.round("inertia", 5).alias("inertia"))


@R.add("SELECT doc_id, 'new' AS lang_tag, source AS source_tag, 2 AS n_tags FROM documents")
def tag_merge(t):
    merged = T.merge_tags(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")), F.create_map(F.lit("lang"), F.lit("new")))
    return t.documents.select("doc_id", merged.alias("m")).select("doc_id", F.col("m")["lang"].alias("lang_tag"), F.col("m")["source"].alias("source_tag"), F.size("m").alias("n_tags"))


@R.add("SELECT count(DISTINCT label) AS clusters, count(DISTINCT label) FILTER (vec_id % 120 = 7) AS changed_clusters, round(1 - count(DISTINCT label) FILTER (vec_id % 120 = 7) / greatest(count(DISTINCT label), 1), 6) AS saved FROM embeddings")
def export_savings(t):
    return T.export_savings(t.embeddings.where("vec_id % 120 = 7"), t.embeddings, "vec_id", "label")


@R.add("SELECT conv_id, count(*) AS spans, min(turn) AS first_turn, max(turn) AS last_turn, count(DISTINCT role) AS roles FROM conversations GROUP BY 1")
def trace_spans(t):
    """Every trace with its spans."""
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("spans"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count_distinct("role").alias("roles"))


@R.add("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, ts + INTERVAL 300 SECOND < TIMESTAMP '2024-01-15' AS expired FROM events")
def timestamps(t):
    back = F.to_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    expired = F.col("ts") + F.expr("interval 300 seconds") < F.lit("2024-01-15").cast("timestamp_ntz")
    return t.events.select("event_id", F.date_format(back, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), expired.alias("expired"))


@R.add("""SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events""")
def json_props(t):
    props = F.from_json("props", F.lit("map<string,string>"))
    keys = F.json_object_keys("props")
    return t.events.select("event_id", props[keys[0]].alias("first_value"), F.size(keys).cast("long").alias("n_keys"))


@R.add("""WITH n AS (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS free FROM supplier) SELECT s_suppkey, CASE WHEN free < 1000 THEN 'unhealthy' WHEN free < 3000 THEN 'degraded' ELSE 'healthy' END AS status FROM n""")
def disk_health(t):
    free = F.greatest("s_acctbal", F.lit(0.0))
    return t.supplier.select("s_suppkey", F.when(free < 1000, "unhealthy").when(free < 3000, "degraded").otherwise("healthy").alias("status"))


@R.add("SELECT user_id, event_type, round(avg(value), 8) AS mean, count(*) AS n FROM events GROUP BY 1, 2")
def savings_averages(t):
    return t.events.groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 8).alias("mean"), F.count("*").alias("n"))


@R.add("SELECT date_trunc('day', ts) AS window_start, event_type, CASE " + " ".join(f"WHEN value <= {b} THEN {i}" for i, b in enumerate(observability.BOUNDS)) + f" ELSE {len(observability.BOUNDS)} END AS bucket, count(*) AS n FROM events GROUP BY ALL")
def windowed_histogram(t):
    """The batch form of the streaming histogram."""
    rows = t.events.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("window_start"), "event_type", observability.bucket(F.col("value")).alias("bucket"))
    return rows.groupBy("window_start", "event_type", "bucket").agg(F.count("*").alias("n"))
