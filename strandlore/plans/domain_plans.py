"""Chunks, reference counts, garbage collection, replicas, lineage, checkpoints, artifacts and metrics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from strandlore.functions import hashing as H
from strandlore.operators import chunks, history, lifecycle, observability, provenance, replication
from strandlore.plans.base import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

NOW = "2024-02-01 00:00:00"
SEEN = "2001-09-01 00:00:00"


def now(text: str):
    return F.lit(text).cast("timestamp")


# ---- chunks and content ids

_FIXED = """c AS (SELECT doc_id, g::INTEGER AS ordinal, g * 1000 AS chunk_offset, substr(text, CAST(g * 1000 + 1 AS BIGINT), 1000) AS chunk
  FROM documents, unnest(range(0, greatest(CAST(ceil(length(text) / 1000.0) AS BIGINT), 1))) AS u(g))"""


@R.add(f"WITH {_FIXED} SELECT doc_id, ordinal, chunk_offset, length(chunk) AS chunk_length, 'sha256:' || sha256(chunk) AS fingerprint FROM c")
def fixed_chunks(t):
    return chunks.chunk_fingerprints(t.documents, "doc_id", "text", 1000)


@R.add(f"WITH {_FIXED} SELECT count(*) AS total_chunks, count(DISTINCT chunk) AS distinct_chunks, round(count(DISTINCT chunk) / count(*), 6) AS ratio FROM c")
def chunk_dedup_ratio(t):
    n, d = F.count("*"), F.count_distinct("fingerprint")
    return chunks.chunk_fingerprints(t.documents, "doc_id", "text", 1000).agg(n.alias("total_chunks"), d.alias("distinct_chunks"), F.round(d / n, 6).alias("ratio"))


@R.add("SELECT doc_id, sha256(text) AS payload_hash, true AS intact FROM documents")
def reassemble_check(t):
    whole = chunks.reassemble(chunks.fixed_chunks(t.documents, "doc_id", "text", 1000), "doc_id")
    both = whole.join(t.documents.select("doc_id", F.sha2("text", 256).alias("_want")), "doc_id")
    return both.select("doc_id", F.sha2("payload", 256).alias("payload_hash"), (F.sha2("payload", 256) == F.col("_want")).alias("intact"))


@R.add("""WITH l AS (SELECT l_orderkey, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS ordinal FROM lineitem),
  a AS (SELECT l_orderkey, sum(q) AS total, count(*) AS n FROM l GROUP BY 1)
SELECT o_orderkey, o_orderkey % 11 <> 0 AS version_ok, o_orderkey % 7 <> 0 OR n IS NULL AS count_ok, o_orderkey % 5 <> 0 OR n IS NULL AS total_ok, o_orderkey % 3 <> 0 OR n IS NULL OR n = 1 AS contiguous_ok
FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""")
def chunk_manifest_validate(t):
    """Orders as manifests, lines as chunks; faults are planted by key so that each check fails for some."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = t.lineitem.select("l_orderkey", F.col("l_quantity").cast("long").alias("chunk_length"), (F.row_number().over(order) - 1).alias("ordinal"))
    start = F.coalesce(F.sum("chunk_length").over(Window.partitionBy("l_orderkey").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = F.when((F.col("l_orderkey") % 3 == 0) & (F.col("ordinal") > 0), start + 1).otherwise(start)
    parts = rows.select(F.col("l_orderkey").alias("o_orderkey"), "ordinal", "chunk_length", shifted.alias("chunk_offset"))
    sums = parts.groupBy("o_orderkey").agg(F.sum("chunk_length").alias("total_size"), F.count("*").alias("chunk_count"))
    k = F.col("o_orderkey")
    manifests = t.orders.select("o_orderkey").join(sums, "o_orderkey", "left").select(
        "o_orderkey",
        F.when(k % 11 == 0, 99).otherwise(1).alias("version"),
        (F.coalesce("total_size", F.lit(0)) + F.when((k % 5 == 0) & F.col("total_size").isNotNull(), 1).otherwise(0)).alias("total_size"),
        (F.coalesce("chunk_count", F.lit(0)) + F.when((k % 7 == 0) & F.col("chunk_count").isNotNull(), 1).otherwise(0)).alias("chunk_count"),
    )
    return chunks.manifest_validity(parts, manifests, "o_orderkey")


@R.add("""SELECT 'sha256:' || sha256(text) AS blob_id, count(*) AS n_copies, min(doc_id) AS first_origin, any_value(strlen(text)) AS size_bytes FROM documents GROUP BY 1""")
def blob_dedup_stats(t):
    return t.documents.groupBy(H.blob_id("text").alias("blob_id")).agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("first_origin"), F.first(F.octet_length("text").cast("long")).alias("size_bytes"))


@R.add("""WITH b AS (SELECT sha256(text) AS h, doc_id FROM documents)
SELECT 'sha256/' || substr(h, 1, 2) || '/' || substr(h, 3) AS path, 'sha256:' || h AS blob_id, 'origin__' || doc_id AS filename, true AS intact FROM b""")
def blob_paths(t):
    blob = H.blob_id("text")
    rows = t.documents.select("doc_id", "text", blob.alias("blob_id"))
    again = H.canonical_blob_id(F.concat(F.lit("/store/"), F.col("blob_id"), F.lit(".blob")))
    return rows.select(H.fanout_path(again).alias("path"), again.alias("blob_id"), H.safe_filename(F.concat(F.lit("origin:"), F.col("doc_id"))).alias("filename"), H.is_intact(F.col("blob_id"), F.col("text")).alias("intact"))


@R.add("SELECT doc_id, sha256(text) AS content, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS deduped FROM documents")
def first_seen_dedup(t):
    return history.first_seen(t.documents.select("doc_id", F.sha2("text", 256).alias("content")), "content", "doc_id")


@R.add("SELECT doc_id, CASE WHEN strlen(text) <= 4096 THEN 'inline' ELSE 'chunked' END AS storage FROM documents")
def inline_threshold(t):
    return t.documents.select("doc_id", chunks.inline_or_chunked(F.octet_length("text"), 4096).alias("storage"))


@R.add(r"""WITH b AS (SELECT item_id, string_split_regex(lower(trim(text)), '\s+') AS w FROM benchmark),
  g AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 12), ' ') AS gram FROM b, unnest(range(1, len(w) - 11)) AS u(i)),
  d AS (SELECT doc_id, string_split_regex(lower(trim(text)), '\s+') AS w FROM documents),
  dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 12), ' ') AS gram FROM d, unnest(range(1, len(w) - 11)) AS u(i))
SELECT item_id, doc_id, count(*) AS shared_grams FROM g JOIN dg USING (gram) GROUP BY 1, 2""")
def benchmark_overlap(t):
    return provenance.shared_grams(t.documents, t.benchmark, "doc_id", "item_id", "text")


# ---- reference counts, tiers, garbage collection


def _deltas(t):
    change = F.when(F.col("event_type").isin("signup", "click"), 1).when(F.col("event_type").isin("error", "view"), -1).otherwise(0)
    return t.events.select("user_id", "event_id", "ts", change.cast("long").alias("delta"))


_DELTA = "SELECT user_id, event_id, ts, CASE WHEN event_type IN ('signup', 'click') THEN 1 WHEN event_type IN ('error', 'view') THEN -1 ELSE 0 END AS delta FROM events"


@R.add(f"""WITH e AS ({_DELTA}), s AS (SELECT user_id, delta, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, (sum(delta) - least(0, min(run)))::BIGINT AS ref_count FROM s GROUP BY 1""")
def refcount_floor(t):
    return lifecycle.floored_counts(_deltas(t), "user_id", "delta", ["ts", "event_id"], F.to_date("ts"))


@R.add("SELECT user_id, count(*) AS access_count, min(ts) AS first_accessed_at, max(ts) AS last_accessed_at FROM events GROUP BY 1")
def access_records(t):
    return lifecycle.access_records(t.events, "user_id", "ts")


@R.add(f"""WITH a AS (SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1)
SELECT user_id, CASE WHEN epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(last))::BIGINT >= 604800 THEN 'cold' WHEN n >= 10 AND epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(last))::BIGINT <= 172800 THEN 'hot' ELSE 'warm' END AS tier FROM a""")
def tier_classify(t):
    idle = F.unix_timestamp(now(NOW)) - F.unix_timestamp("last_accessed_at")
    return lifecycle.access_records(t.events, "user_id", "ts").select("user_id", lifecycle.tier(F.col("access_count"), idle, hot_seconds=2 * 86400).alias("tier"))


def _origins(t):
    """Customers as origins: lifetime by segment; orders not yet filled are references, by status."""
    ttl = F.when(F.col("c_mktsegment") == "BUILDING", 100).when(F.col("c_mktsegment") == "MACHINERY", 10**9)
    return t.customer.select(F.col("c_custkey").alias("origin_id"), F.lit("2001-01-01 00:00:00").cast("timestamp").alias("created_at"), ttl.alias("ttl_seconds"))


@R.add(f"""WITH c AS (SELECT o_custkey AS origin_id, count(*) FILTER (o_orderpriority LIKE '1%') AS refs, bool_or(o_orderstatus = 'P') AS pinned FROM orders GROUP BY 1)
SELECT c_custkey AS origin_id FROM customer LEFT JOIN c ON origin_id = c_custkey WHERE coalesce(refs, 0) = 0 AND NOT coalesce(pinned, false)
 AND (CASE c_mktsegment WHEN 'BUILDING' THEN 100 WHEN 'MACHINERY' THEN 1000000000 END IS NULL
   OR epoch(TIMESTAMP '{SEEN}') - epoch(TIMESTAMP '2001-01-01') >= CASE c_mktsegment WHEN 'BUILDING' THEN 100 WHEN 'MACHINERY' THEN 1000000000 END)""")
def gc_plan_origins(t):
    refs = t.orders.groupBy(F.col("o_custkey").alias("origin_id")).agg(F.count_if(F.col("o_orderpriority").startswith("1")).alias("ref_count"))
    pins = t.orders.select(F.col("o_custkey").alias("origin_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("released").alias("state"))
    return lifecycle.gc_plan(_origins(t), refs, pins, now(SEEN))


@R.add("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01')")
def gc_plan_blobs(t):
    live = t.lineitem.where("l_shipdate >= timestamp'2000-01-01'").select(F.col("l_partkey").alias("p_partkey"))
    return lifecycle.unreferenced(t.part.select("p_partkey"), live, "p_partkey")


@R.add("""WITH plan AS (SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'))
SELECT 'tombstone' AS kind, p_partkey, sha256('tombstone:' || p_partkey) AS tombstone_id FROM plan
UNION ALL SELECT 'kept', p_partkey, NULL FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM plan)""")
def gc_execute(t):
    stones, kept = lifecycle.gc_execute(t.part.select("p_partkey"), gc_plan_blobs(t), "p_partkey")
    return stones.select(F.lit("tombstone").alias("kind"), "p_partkey", "tombstone_id").unionByName(kept.select(F.lit("kept").alias("kind"), "p_partkey", F.lit(None).cast("string").alias("tombstone_id")))


@R.add("SELECT l_partkey, -count(*) AS delta FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def tombstone_effects(t):
    gone = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return lifecycle.tombstone_releases(t.lineitem, gone, "l_orderkey", "l_partkey")


@R.add("SELECT p_partkey FROM part ANTI JOIN lineitem ON p_partkey = l_partkey")
def orphans(t):
    return lifecycle.unreferenced(t.part.select("p_partkey"), t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


_HALVES = """old AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'), new AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')"""


@R.add(f"WITH {_HALVES} SELECT l_partkey, CASE WHEN l_partkey IN (SELECT l_partkey FROM new) THEN 'live' ELSE 'stale' END AS state FROM old")
def manifest_stale(t):
    """Blobs of the old manifest that the new one dropped, checked against all manifests."""
    old = t.lineitem.where("l_shipdate < timestamp'1998-01-01'").select("l_partkey").distinct()
    new = t.lineitem.where("l_shipdate >= timestamp'1998-01-01'").select("l_partkey", F.lit("live").alias("state")).distinct()
    return old.join(new, "l_partkey", "left").withColumn("state", F.coalesce("state", F.lit("stale")))


@R.add(f"WITH {_HALVES} SELECT 'both' AS part, l_partkey FROM (SELECT * FROM old INTERSECT SELECT * FROM new) UNION ALL SELECT 'only_old', l_partkey FROM (SELECT * FROM old EXCEPT SELECT * FROM new)")
def manifest_sets(t):
    old = t.lineitem.where("l_shipdate < timestamp'1998-01-01'").select("l_partkey")
    new = t.lineitem.where("l_shipdate >= timestamp'1998-01-01'").select("l_partkey")
    return old.intersect(new).select(F.lit("both").alias("part"), "l_partkey").union(old.subtract(new).select(F.lit("only_old").alias("part"), "l_partkey"))


@R.add("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_wins(t):
    return lifecycle.latest_wins(t.events.select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@R.add("""SELECT DISTINCT sha256(text) AS fingerprint, source FROM documents WHERE doc_id % 2 = 1 AND (sha256(text), source) NOT IN (SELECT sha256(text), source FROM documents WHERE doc_id % 2 = 0)""")
def insert_or_ignore(t):
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("fingerprint"), "source")
    return lifecycle.insert_or_ignore(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), ["fingerprint", "source"]).select("fingerprint", "source")


@R.add("""WITH e AS (SELECT user_id AS entry, count(*) AS uses, max(ts) AS last_use, user_id % 10 = 0 AS pinned FROM events GROUP BY 1),
 r AS (SELECT entry, uses, last_use, row_number() OVER (ORDER BY uses, last_use, entry) AS eviction_rank FROM e WHERE NOT pinned)
SELECT entry, uses, last_use, eviction_rank FROM r WHERE eviction_rank <= (SELECT count(*) FROM e) - 40""")
def cache_eviction_plan(t):
    entries = t.events.groupBy(F.col("user_id").alias("entry")).agg(F.count("*").alias("uses"), F.max("ts").alias("last_use")).withColumn("pinned", F.col("entry") % 10 == 0)
    return lifecycle.eviction_order(entries, 40)


@R.add("""WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events), u AS (SELECT DISTINCT user_id FROM events), a AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events),
 g AS (SELECT u.user_id, d.day, a.user_id IS NOT NULL AS active FROM u CROSS JOIN d LEFT JOIN a ON a.user_id = u.user_id AND a.day = d.day),
 s AS (SELECT user_id, count(*) FILTER (day > coalesce((SELECT max(day) FROM g g2 WHERE g2.user_id = g.user_id AND g2.active), DATE '1900-01-01')) AS streak FROM g GROUP BY user_id)
SELECT user_id, streak, streak >= 2 AS prune FROM s""")
def zero_streak_prune(t):
    """Days of the log after each user's last one."""
    return lifecycle.idle_steps(t.events.select("user_id", F.to_date("ts").alias("day")), "user_id", "day", 2)


# ---- replicas and nodes


def _replicas(t):
    state = F.when(F.col("l_returnflag") == "R", "dead").otherwise("healthy")
    return t.lineitem.groupBy(F.col("l_partkey").alias("blob_id"), F.col("l_suppkey").alias("node_id")).agg(F.max("l_shipdate").alias("last_seen"), F.min(state).alias("state"))


_REPLICAS = "rep AS (SELECT l_partkey AS blob_id, l_suppkey AS node_id, max(l_shipdate) AS last_seen, min(CASE WHEN l_returnflag = 'R' THEN 'dead' ELSE 'healthy' END) AS state FROM lineitem GROUP BY 1, 2)"
_STALE = 2 * 365 * 86400
_AUDIT = f"""{_REPLICAS}, h AS (SELECT blob_id, count(*) FILTER (state = 'healthy' AND epoch(TIMESTAMP '{SEEN}') - epoch(last_seen) <= {_STALE}) AS healthy FROM rep GROUP BY 1),
 req AS (SELECT p_partkey AS blob_id, 3 + p_size % 3 AS required, p_brand FROM part),
 aud AS (SELECT blob_id, required, coalesce(healthy, 0) AS healthy, required - coalesce(healthy, 0) AS missing FROM req LEFT JOIN h USING (blob_id) WHERE coalesce(healthy, 0) < required)"""


def _required(t):
    return t.part.select(F.col("p_partkey").alias("blob_id"), (F.col("p_size") % 3 + 3).cast("long").alias("required"), "p_brand")


def _needs(t):
    return replication.audit(_required(t), _replicas(t), now(SEEN), _STALE)


@R.add(f"WITH {_AUDIT} SELECT blob_id, required::BIGINT AS required, healthy, missing::BIGINT AS missing FROM aud")
def replica_audit(t):
    return _needs(t)


@R.add(f"WITH {_AUDIT} SELECT p_brand, bool_and(coalesce(healthy, 0) >= required) AS can_delete FROM req LEFT JOIN h USING (blob_id) GROUP BY 1")
def durability_gate(t):
    return replication.can_delete(_required(t), _replicas(t), "p_brand", now(SEEN), _STALE)


def _nodes(t):
    """Suppliers as nodes: capacity from the balance, use from the lines they shipped, heartbeat from the last one."""
    use = t.lineitem.groupBy(F.col("l_suppkey").alias("node_id")).agg(F.count("*").alias("used_gb"), F.max("l_shipdate").alias("last_heartbeat"))
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    rows = t.supplier.select(F.col("s_suppkey").alias("node_id"), "s_nationkey", F.greatest(F.floor("s_acctbal"), F.lit(0)).alias("capacity_gb"))
    return rows.join(use, "node_id", "left").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "node_id", "region", "capacity_gb", F.coalesce("used_gb", F.lit(0)).alias("used_gb"), "last_heartbeat", F.when(F.col("node_id") % 7 == 0, "offline").when(F.col("node_id") % 5 == 0, "degraded").otherwise("healthy").alias("status"),
        F.when(F.col("node_id") % 2 == 0, "edge").otherwise("storage").alias("role"),
    )


_NODES = """node AS (SELECT s_suppkey AS node_id, r_name AS region, greatest(floor(s_acctbal), 0)::BIGINT AS capacity_gb, coalesce(n, 0) AS used_gb, hb AS last_heartbeat,
  CASE WHEN s_suppkey % 7 = 0 THEN 'offline' WHEN s_suppkey % 5 = 0 THEN 'degraded' ELSE 'healthy' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'edge' ELSE 'storage' END AS role
  FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, max(l_shipdate) AS hb FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 load AS (SELECT *, CASE WHEN capacity_gb <= 0 THEN 1.0::DOUBLE ELSE used_gb / capacity_gb END AS load FROM node)"""


@R.add(f"WITH {_NODES} SELECT node_id, role, status, region FROM node WHERE status <> 'offline' AND epoch(TIMESTAMP '{SEEN}') - epoch(last_heartbeat) <= 30000000 AND role = 'storage'")
def healthy_nodes(t):
    return replication.healthy_nodes(_nodes(t), now(SEEN), 30_000_000, "storage").select("node_id", "role", "status", "region")


@R.add(f"WITH {_NODES} SELECT node_id, load AS utilization FROM load ORDER BY load, node_id LIMIT 1")
def least_loaded(t):
    return replication.least_loaded(_nodes(t))


@R.add(f"""WITH {_AUDIT}, {_NODES}, rk AS (SELECT node_id, row_number() OVER (ORDER BY (region <> 'ASIA')::INT, load, node_id) AS node_rank FROM load),
 f AS (SELECT aud.blob_id, node_id, missing, row_number() OVER (PARTITION BY aud.blob_id ORDER BY node_rank) AS choice FROM aud CROSS JOIN rk WHERE (aud.blob_id, node_id) NOT IN (SELECT blob_id, node_id FROM rep))
SELECT blob_id, node_id, choice::INTEGER AS choice FROM f WHERE choice <= missing""")
def replication_targets(t):
    return replication.placements(_needs(t), _replicas(t), _nodes(t), "ASIA")


@R.add("SELECT l_partkey, count(DISTINCT l_suppkey) AS acks, count(DISTINCT l_suppkey) >= 3 AS committed FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def quorum_plan(t):
    return replication.quorum(t.lineitem.where("l_linestatus = 'F'").withColumnRenamed("l_suppkey", "node_id"), "l_partkey", 3)


@R.add(f"""WITH {_REPLICAS}, c AS (SELECT p_partkey, p_size % 10 <> 0 AS ok, count(node_id) AS replicas FROM part LEFT JOIN rep ON blob_id = p_partkey GROUP BY ALL)
SELECT count(*) AS total, count(*) FILTER (ok AND replicas >= 20) AS healthy, count(*) FILTER (NOT ok) AS corrupt, count(*) FILTER (ok AND replicas < 20) AS under_replicated, round(count(*) FILTER (ok AND replicas >= 20) * 100.0::DOUBLE / count(*), 4) AS healthy_pct FROM c""")
def consistency_report(t):
    counts = _replicas(t).groupBy(F.col("blob_id").alias("p_partkey")).agg(F.count("*").alias("replicas"))
    blobs = t.part.select("p_partkey", "p_size").join(counts, "p_partkey", "left").withColumn("replicas", F.coalesce("replicas", F.lit(0)))
    return replication.consistency(blobs, F.col("p_size") % 10 != 0, 20)


@R.add("""WITH o AS (SELECT l_partkey, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS priority, l_suppkey FROM lineitem)
SELECT l_partkey, min(priority) AS priority, arg_min(l_suppkey, (priority, l_suppkey)) AS l_suppkey FROM o GROUP BY 1""")
def ordered_fallback(t):
    offers = t.lineitem.select("l_partkey", F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("priority"), "l_suppkey")
    return replication.first_source(offers.withColumn("_p", F.struct("priority", "l_suppkey")), "l_partkey", "_p").drop("_p")


# ---- lineage, checkpoints, artifacts


@R.add("""WITH e AS (SELECT conv_id, conv_id || ':' || turn AS edge_id, 'share:' || role || ':' || conv_id || ':' || turn AS kind FROM conversations)
SELECT conv_id, sha256(string_agg(edge_id || '|' || kind, chr(10) ORDER BY edge_id)) AS digest, count(*) AS n_edges FROM e GROUP BY 1""")
def lineage_digest(t):
    edges = t.conversations.withColumn("edge_id", F.concat_ws(":", "conv_id", "turn"))
    return history.lineage_digest(edges, "conv_id", "edge_id", history.canonical_kind(F.lit("share"), F.col("role"), F.col("conv_id"), F.col("turn")))


@R.add("""SELECT o_custkey, sha256(string_agg(lpad(o_orderkey::VARCHAR, 12, '0') || '|pin:' || o_orderstatus, chr(10) ORDER BY lpad(o_orderkey::VARCHAR, 12, '0'))) AS digest, count(*) AS n_edges
FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1""")
def share_cutoff_digest(t):
    edges = t.orders.withColumn("edge_id", F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    return history.lineage_digest(edges, "o_custkey", "edge_id", history.canonical_kind(F.lit("pin"), F.col("o_orderstatus")), F.col("o_orderdate") < "1998-01-01")


@R.add("""WITH RECURSIVE n AS (SELECT conv_id * 1000 + turn AS node_id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id FROM conversations),
 up AS (SELECT node_id, node_id AS ancestor_id, 0 AS depth FROM n UNION ALL SELECT u.node_id, n.parent_id, u.depth + 1 FROM up u JOIN n ON u.ancestor_id = n.node_id WHERE n.parent_id IS NOT NULL )
SELECT node_id, ancestor_id, depth FROM up""")
def checkpoint_lineage(t):
    node = F.col("conv_id") * 1000 + F.col("turn")
    return history.chain(t.conversations.select(node.alias("node_id"), F.when(F.col("turn") > 0, node - 1).alias("parent_id")))


@R.add("SELECT o_custkey, max((o_orderdate, o_orderkey))[2] AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1")
def checkpoint_latest(t):
    rows = t.orders.withColumn("seq", F.struct("o_orderdate", "o_orderkey"))
    return history.latest_by_insertion(rows, "o_custkey", "seq", "o_totalprice").select("o_custkey", "seq.o_orderkey", "o_totalprice")


@R.add("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3 AS stays FROM orders")
def keep_last_n(t):
    return history.keep_last(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).drop("o_orderdate")


@R.add(f"""WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT o_orderkey AS artifact_id, o_custkey AS origin_id FROM r WHERE n > 2 AND NOT starts_with(o_orderpriority, '1') AND epoch(TIMESTAMP '{SEEN}') - epoch(o_orderdate) > 86400 * 700""")
def retention(t):
    rows = t.orders.select(F.col("o_orderkey").alias("artifact_id"), F.col("o_custkey").alias("origin_id"), F.col("o_orderdate").alias("created_at"), "o_orderpriority")
    return history.retention(rows, now(SEEN), 2, 86400 * 700, F.col("o_orderpriority").startswith("1")).select("artifact_id", "origin_id")


@R.add("""WITH m AS (SELECT l_returnflag AS k, l_linestatus AS name, year(l_shipdate) AS y, round(avg(l_discount), 6) AS v FROM lineitem GROUP BY ALL)
SELECT a.k, a.name, a.v AS old_value, b.v AS new_value, round(b.v - a.v, 6) AS delta FROM m a JOIN m b USING (k, name) WHERE a.y = 1996 AND b.y = 1997""")
def checkpoint_diff(t):
    m = t.lineitem.groupBy(F.col("l_returnflag").alias("k"), F.col("l_linestatus").alias("name"), F.year("l_shipdate").alias("y")).agg(F.round(F.avg("l_discount"), 6).alias("v"))
    return history.metric_diff(m.where("y = 1996"), m.where("y = 1997"), "k", "name", "v").withColumn("delta", F.round("delta", 6))


@R.add("""SELECT lang AS artifact_type, count(*) AS n, sum(strlen(text))::BIGINT AS raw_bytes, sum(n_chars)::BIGINT AS stored_bytes, round(1 - sum(n_chars) / sum(strlen(text)), 6) AS saved FROM documents GROUP BY GROUPING SETS ((lang), ())""")
def artifact_stats(t):
    rows = t.documents.select(F.col("lang").alias("artifact_type"), F.octet_length("text").cast("long").alias("raw"), F.col("n_chars").alias("stored"))
    return history.artifact_stats(rows, "artifact_type", "raw", "stored")


@R.add("SELECT doc_id, 'Doc-' || doc_id AS name FROM documents WHERE lang = 'en' AND source = 'src1' AND contains(lower('Doc-' || doc_id), 'doc-1')")
def artifact_search(t):
    rows = t.documents.select("doc_id", F.concat(F.lit("Doc-"), F.col("doc_id")).alias("name"), F.col("lang").alias("artifact_type"), F.create_map(F.lit("source"), F.col("source")).alias("tags"))
    return history.find_artifacts(rows, "en", {"source": "src1"}, "DOC-1").select("doc_id", "name")


@R.add("SELECT doc_id, n_chars FROM documents WHERE lang = 'fr'")
def list_by_type(t):
    rows = t.documents.select("doc_id", "n_chars", F.col("lang").alias("artifact_type"))
    return history.find_artifacts(rows, "fr").select("doc_id", "n_chars")


@R.add("""SELECT source AS stage, sha256(length(lang) || '|' || lang || length(source) || '|' || source) AS config_hash, lang IN ('en', 'de') AS reuse FROM documents GROUP BY ALL""")
def reuse_resolve(t):
    rows = t.documents.select(F.col("source").alias("stage"), H.pipeline_hash(F.col("lang"), F.col("source")).alias("config_hash"), "lang").distinct()
    return history.reuse(rows.select("stage", "config_hash"), rows.where("lang in ('en', 'de')"))


@R.add("""WITH b AS (SELECT l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS n FROM lineitem)
SELECT l_suppkey, count(*) FILTER (n = 1) AS stored, count(*) FILTER (n > 1) AS deduped, sum(l_quantity)::BIGINT AS raw_bytes, coalesce(sum(l_quantity) FILTER (n = 1), 0)::BIGINT AS stored_bytes FROM b GROUP BY 1""")
def import_summary(t):
    rows = t.lineitem.withColumn("seq", F.struct("l_orderkey", "l_linenumber", "l_quantity"))
    return history.import_summary(rows, "l_suppkey", ["l_partkey"], "seq", "l_quantity")


@R.add("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::BIGINT AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def layer_rollup(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("total"))


@R.add("""WITH s AS (SELECT source, count(*) AS n, sum(count(*)) OVER (ORDER BY source) AS hi FROM documents GROUP BY 1), q AS (SELECT range AS idx FROM range(0, (SELECT count(*) FROM documents)))
SELECT idx, source, (idx - (hi - n))::BIGINT AS local_idx FROM q JOIN s ON idx >= hi - n AND idx < hi""")
def shard_lookup(t):
    """Global row index to (shard, row in it) over cumulative shard sizes; the index of a shard's rows is generated, in
    spans that no task holds too many of, so no range join is needed."""
    shards = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    lo = F.sum("n").over(Window.orderBy("source")) - F.col("n")
    rows = shards.withColumn("lo", lo).select("source", "lo", "n", F.explode(F.expr("sequence(bigint(0), n - 1, bigint(65536))")).alias("span"))
    rows = rows.repartition("source", "span").select("source", "lo", F.explode(F.expr("sequence(span, least(span + 65536, n) - 1)")).alias("local_idx"))
    return rows.select((F.col("lo") + F.col("local_idx")).alias("idx"), "source", "local_idx")


@R.add("SELECT source, (row_number() OVER (ORDER BY source) - 1) % 4 AS worker FROM (SELECT DISTINCT source FROM documents)")
def worker_shards(t):
    return t.documents.select("source").distinct().withColumn("worker", ((F.row_number().over(Window.orderBy("source")) - 1) % 4).cast("long"))


@R.add("SELECT vec_id, (vec_id // 128)::BIGINT AS shard_id, count(*) OVER (PARTITION BY vec_id // 128) AS shard_rows FROM embeddings")
def shard_assign(t):
    shard = F.floor(F.col("vec_id") / 128)
    sizes = t.embeddings.groupBy(shard.alias("shard_id")).agg(F.count("*").alias("shard_rows"))
    return t.embeddings.select("vec_id", shard.alias("shard_id")).join(sizes, "shard_id").select("vec_id", "shard_id", "shard_rows")


# ---- observability

_BUCKET = "CASE " + " ".join(f"WHEN value / 100.0 <= {b} THEN {i}" for i, b in enumerate(observability.BOUNDS)) + f" ELSE {len(observability.BOUNDS)} END"


def _observed(t):
    return t.events.select("event_type", (F.col("value") / 100.0).alias("value"), "event_id", "ts")


@R.add(f"SELECT event_type, {_BUCKET} AS bucket, count(*) AS n FROM events GROUP BY ALL")
def metrics_histogram(t):
    return observability.histogram(_observed(t), "event_type", "value")


@R.add("SELECT event_type, count(*) AS n, round(sum(value / 100.0), 4) AS total, round(avg(value / 100.0), 4) AS mean, min(value / 100.0) AS least, max(value / 100.0) AS most FROM events GROUP BY 1")
def metrics_summary(t):
    return observability.summary(_observed(t), "event_type", "value")


@R.add(f"""WITH h AS (SELECT event_type, {_BUCKET} AS bucket, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT event_type, bucket, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY event_type) AS total FROM h)
SELECT event_type, {observability.BOUNDS}[1 + least(min(bucket), 11)]::DOUBLE AS percentile FROM r WHERE run >= total * 0.5::DOUBLE GROUP BY 1""")
def percentile_bucket(t):
    return observability.percentile_bucket(observability.histogram(_observed(t), "event_type", "value"), "event_type", 0.5)


@R.add("SELECT event_type, round(sum(value / 100.0), 4) AS counter, arg_max(value / 100.0, event_id) AS gauge FROM events GROUP BY 1")
def counters_gauges(t):
    return observability.counters_and_gauges(_observed(t), "event_type", "value", "event_id")


@R.add("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, user_id % 13 = 0 AS bad FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, max(value) FILTER (i = n // 2) AS p50, max(value) FILTER (i = least(floor(n * 0.95::DOUBLE), n - 1)) AS p95, count(*) FILTER (bad) AS errors FROM s GROUP BY 1""")
def span_summary(t):
    return observability.span_summary(t.events, "event_type", "value", F.col("user_id") % 13 == 0)


@R.add("SELECT event_id, event_type, value FROM events WHERE value >= 100 ORDER BY value DESC, event_id LIMIT 50")
def slow_spans(t):
    return t.events.where("value >= 100").select("event_id", "event_type", "value").orderBy(F.desc("value"), "event_id").limit(50)


@R.add("""WITH c AS (SELECT event_type, CASE WHEN max(value) > 400 THEN 2 WHEN avg(value) > 60 THEN 1 ELSE 0 END AS severity FROM events GROUP BY 1)
SELECT CASE max(severity) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS overall, count(*) AS components FROM c""")
def health_rollup(t):
    parts = t.events.groupBy("event_type").agg(F.when(F.max("value") > 400, 2).when(F.avg("value") > 60, 1).otherwise(0).alias("severity"))
    return parts.agg(observability.worst(F.col("severity")).alias("overall"), F.count("*").alias("components"))
