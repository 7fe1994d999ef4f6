"""Vector search, clusters, softmax, attention, incremental diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def wide(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in the order of the components, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    return F.transform(F.array(F.struct(v.alias("v"), norm(v).alias("n"))), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]))[0]


def cosine(a: Column, b: Column) -> Column:
    """Zero if either norm is below 1e-12."""
    return F.when((norm(a) < 1e-12) | (norm(b) < 1e-12), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


#: Queries that meet the rows in one block.
QUERY_BLOCK = 1024


def against(rows: DataFrame, queries: DataFrame, *names: str) -> DataFrame:
    """Every row with every query of a stated set: the columns of ``rows`` and the ``names`` of ``queries``.

    Queries go in blocks of about QUERY_BLOCK, each one array row. One block is broadcast, so rows stay in their scan;
    of several blocks each meets a copy of the rows, in as many tasks as there are blocks times salts.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    packed = queries.withColumn("_block", F.pmod(F.xxhash64(names[0]), F.lit(blocks)).cast("int")).groupBy("_block").agg(F.collect_list(F.struct(*names)).alias("_asked"))
    if blocks == 1:
        met = rows.join(F.broadcast(packed.drop("_block")))  # one row of QUERY_BLOCK queries
    else:
        salts = 16
        packed = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        every = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = every.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(packed, ["_block", "_salt"]).drop("_block", "_salt")
    return met.withColumn("_a", F.explode("_asked")).select(*rows.columns, *[F.col(f"_a.{n}").alias(n) for n in names])


def top_k(items: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", keep: Column | None = None, filter_mode: str = "post", shard: Column | None = None) -> DataFrame:
    """(query_id, item_id, score, rank): per shard the best k, then the best k of those.

    ``items``: item_id, v and what ``keep`` reads; ``queries``: query_id, q, a stated set that goes in blocks.
    ``filter_mode`` "post" filters a shard's best k (fewer than k may be left), "pre" filters before ranking.
    """
    score = dot(F.col("q"), F.col("v")) if metric == "dot" else cosine(F.col("q"), F.col("v"))
    rows = items if keep is None or filter_mode != "pre" else items.where(keep)
    rows = rows.withColumn("_shard", F.lit(0) if shard is None else shard)
    rows = against(rows, queries, "query_id", "q").withColumn("score", F.round(score, 6)).drop("q", "v")
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "item_id"))
    rows = rows.withColumn("_n", best("query_id", "_shard")).where(F.col("_n") <= k)
    if keep is not None and filter_mode == "post":
        rows = rows.where(keep)
    return rows.withColumn("rank", best("query_id")).where(F.col("rank") <= k).select("query_id", "item_id", "score", "rank")


def centroids(rows: DataFrame, cluster: str, v: str) -> DataFrame:
    """Element-wise means. Components are averaged as rows, so a cluster may have any number of members."""
    parts = rows.select(cluster, F.posexplode(v).alias("_i", "_x")).groupBy(cluster, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return parts.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centroid"))


def assign(rows: DataFrame, centres: DataFrame, key: str, v: str, cluster: str) -> DataFrame:
    """Nearest centre per row; the centres (a few hundred) travel as one array row."""
    packed = centres.agg(F.collect_list(F.struct(F.col(cluster).alias("c"), F.col("centroid").alias("m"))).alias("_cs"))
    distances = F.transform("_cs", lambda s: F.struct(squared_distance(F.col("_v"), s["m"]).alias("d"), s["c"].alias("c")))
    best = F.array_min(distances)
    rows = rows.select(key, wide(v).alias("_v")).join(F.broadcast(packed)).withColumn("_best", best)
    return rows.select(key, F.col("_best.c").alias("nearest"), F.col("_best.d").alias("distance"))


def lloyd(rows: DataFrame, key: str, v: str, k: int, steps: int, seed: int = 42, tolerance: float = 1e-6, start: list[list[float]] | None = None):
    """Lloyd's k-means: centres start at ``start``, or at the k rows of smallest hash. (centres, assignments). k is small, so centres pass through the driver."""
    spark = rows.sparkSession
    if start is None:
        chosen = rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(k).select(wide(v).alias("centroid")).collect()
        start = [list(r["centroid"]) for r in chosen]
    centres = list(enumerate(start))
    for _ in range(steps):
        frame = spark.createDataFrame(centres, "cluster int, centroid array<double>")
        placed = assign(rows, frame, key, v, "cluster").join(rows.select(key, v), key)
        moved = {r["nearest"]: list(r["centroid"]) for r in centroids(placed, "nearest", v).collect()}
        fresh = [(c, moved.get(c, m)) for c, m in centres]
        shift = max(sum((a - b) ** 2 for a, b in zip(m, n, strict=True)) ** 0.5 for (_, m), (_, n) in zip(centres, fresh, strict=True))
        centres = fresh
        if shift < tolerance:
            break
    frame = spark.createDataFrame(centres, "cluster int, centroid array<double>")
    return frame, assign(rows, frame, key, v, "cluster")


def cluster_stats(rows: DataFrame, cluster: str) -> DataFrame:
    """One row: clusters, sizes and their ratio."""
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("clusters"), F.min("n").alias("size_min"), F.max("n").alias("size_max"), F.round(F.avg("n"), 4).alias("size_mean"),
        F.round(F.max("n") / F.greatest(F.min("n"), F.lit(1)), 4).alias("size_ratio"),
    )


def softmax(logit: Column, *by: str) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp(logit - F.max(logit).over(w))
    return e / F.sum(e).over(w)


def hierarchical_softmax(rows: DataFrame, key: str, cluster: str, v: str, hidden: Column, top_clusters: int) -> DataFrame:
    """p(token) = p(cluster) * p(token | cluster) over the members of the best clusters; others are never scored."""
    logits = centroids(rows, cluster, v).withColumn("_logit", dot(F.col("centroid"), hidden))
    table = logits.withColumn("cluster_prob", F.exp(F.col("_logit") - F.max("_logit").over(Window.partitionBy()))).withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_logit"), cluster)))
    table = table.withColumn("cluster_prob", F.col("cluster_prob") / F.sum("cluster_prob").over(Window.partitionBy()))
    active = table.where(F.col("_rank") <= top_clusters).select(cluster, "cluster_prob")
    members = rows.join(active, cluster).withColumn("_member", dot(wide(v), hidden))
    inside = members.withColumn("token_prob", softmax(F.col("_member"), cluster))
    return inside.select(key, cluster, "cluster_prob", "token_prob", (F.col("cluster_prob") * F.col("token_prob")).alias("probability"))


def attention(rows: DataFrame, key: str, cluster: str, v: str, query: Column, top_clusters: int, top_items: int, pinned: list | None = None) -> DataFrame:
    """Softmax-weighted sum of the best items in the best (and pinned) clusters: (component, value)."""
    scored = centroids(rows, cluster, v).withColumn("_s", dot(F.col("centroid"), query)).withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_s"), cluster)))
    active = scored.where((F.col("_rank") <= top_clusters) | F.col(cluster).isin(pinned or [])).select(cluster)
    best = rows.join(active, cluster, "left_semi").select(key, wide(v).alias("_v")).withColumn("_s", dot(F.col("_v"), query)).orderBy(F.desc("_s"), key).limit(top_items)
    weights = best.withColumn("_w", softmax(F.col("_s")))
    return weights.select("_w", F.posexplode("_v").alias("component", "_x")).groupBy("component").agg(F.sum(F.col("_w") * F.col("_x")).alias("value"))


def update_savings(batch: DataFrame, assignments: DataFrame, key: str, cluster: str, dims: int) -> DataFrame:
    """One row: distinct tokens and clusters that a batch touches, parameters updated, share saved."""
    touched = assignments.join(batch.select(key).distinct(), key, "left_semi").agg(F.count_distinct(key).alias("unique_tokens"), F.count_distinct(cluster).alias("active_clusters"))
    total = assignments.agg((F.count("*") * dims).alias("standard_params"))
    sparse = (F.col("unique_tokens") + F.col("active_clusters")) * dims
    return touched.join(F.broadcast(total)).select("unique_tokens", "active_clusters", "standard_params", sparse.alias("sparse_params"), F.round(1 - sparse / F.col("standard_params"), 6).alias("savings_ratio"))


def changed(new: DataFrame, snapshot: DataFrame, key: str, v: str, atol: float = 1e-6, rtol: float = 1e-5) -> DataFrame:
    """Keys whose vector differs from the snapshot's beyond the tolerance, or that it lacks."""
    both = new.select(key, wide(v).alias("_a")).join(snapshot.select(key, wide(v).alias("_b")), key, "left")
    far = F.exists(F.zip_with("_a", "_b", lambda a, b: F.abs(a - b) > atol + rtol * F.abs(b)), lambda x: x)
    return both.where(F.col("_b").isNull() | far).select(key)


def shared_gradient(rows: DataFrame, cluster: str, key: str, v: str) -> DataFrame:
    """Residuals of each gradient from its cluster's mean; components up to 1e-6 are dropped to zero."""
    parts = rows.select(cluster, key, F.posexplode(wide(v)).alias("component", "_x"))
    mean = F.avg("_x").over(Window.partitionBy(cluster, "component"))
    return parts.withColumn("_r", F.col("_x") - mean).where(F.abs("_r") > 1e-6).select(cluster, key, "component", F.col("_r").alias("residual"))
