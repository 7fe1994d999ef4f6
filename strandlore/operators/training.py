"""Decision logic of training: patience, freezing, caches, pin windows, cluster maintenance, memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandlore.session import cut


def first_stop(steps: DataFrame, run: str, step: str, similarity: str, threshold: float, patience: int, every: int, at_least: int) -> DataFrame:
    """Per run the first step at which ``patience`` checks in a row were similar enough; checks are every few steps after a start."""
    checks = steps.where((F.col(step) >= at_least) & (F.col(step) % every == 0))
    w = Window.partitionBy(run).orderBy(step)
    island = checks.withColumn("_low", F.sum((F.col(similarity) < threshold).cast("int")).over(w)).withColumn("_good", (F.col(similarity) >= threshold).cast("int"))
    streak = island.withColumn("_streak", F.sum("_good").over(Window.partitionBy(run, "_low").orderBy(step)))
    return streak.where(F.col("_streak") >= patience).groupBy(run).agg(F.min(step).alias("stop_step"))


def freeze(layers: DataFrame, similarity: str, threshold: float, share: float, by: str) -> DataFrame:
    """The most stable layers of each model, up to a share of its layers."""
    w = Window.partitionBy(by).orderBy(F.desc(similarity), "layer")
    rows = layers.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count("*").over(Window.partitionBy(by)))
    return rows.where((F.col(similarity) >= threshold) & (F.col("_n") <= F.floor(F.col("_all") * share))).select(by, "layer", similarity)


def pin_window(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """What to pin and unpin as the window of hot blocks moves."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("action", F.lit("pin")).unionByName(a.join(b, key, "left_anti").withColumn("action", F.lit("unpin")))


def shed(entries: DataFrame, protected: DataFrame, keep: int, key: str, by: str) -> DataFrame:
    """Per cache, entries to drop so that at most ``keep`` unprotected ones stay: rarest, then longest unused."""
    loose = entries.join(protected.select(key).distinct(), key, "left_anti")
    w = Window.partitionBy(by).orderBy(F.desc("uses"), F.desc("last_use"), key)
    return loose.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > keep).select(by, key)


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.count_if("dirty").alias("dirty"), F.count_if("pinned").alias("pinned"))


def flush_plan(writes: DataFrame, key: list[str], seq: str, blob: str, threshold: int) -> DataFrame:
    """Write-back: writes come in flushes of ``threshold``; per flush the last write of a block is stored, and superseded blobs may go.

    (key, flush, blob, live): ``live`` for the newest stored version of a block.
    """
    order = Window.partitionBy(key[0]).orderBy(seq)
    rows = writes.withColumn("flush", F.floor((F.row_number().over(order) - 1) / threshold))
    kept = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "flush").orderBy(F.desc(seq)))).where("_n = 1")
    live = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("flush"))) == 1
    return kept.withColumn("live", live).select(*key, "flush", blob, "live")


def renumber(rows: DataFrame, cluster: str) -> DataFrame:
    """Cluster numbers without gaps, by ranges of clusters: a number is the size of all ranges before and the place in its own."""
    ids = cut(rows.select(cluster).distinct().repartitionByRange(F.col(cluster)).withColumn("_range", F.spark_partition_id()))
    sizes = ids.groupBy("_range").agg(F.count("*").alias("_n"))  # one row a partition
    sizes = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(cluster)) - 1
    ids = ids.withColumn("_place", place).join(F.broadcast(sizes), "_range").select(cluster, (F.col("_first") + F.col("_place")).alias("new_cluster"))
    return rows.join(ids, cluster)


def rebalance_plan(sizes: DataFrame, cluster: str, split_ratio: float = 5.0, merge_ratio: float = 1.5) -> DataFrame:
    """Which cluster to split (largest, if sizes are far apart) or to merge (the two smallest, if they are too alike)."""
    w = Window.partitionBy()
    ratio = F.max("n").over(w) / F.greatest(F.min("n").over(w), F.lit(1))
    down, up = F.row_number().over(Window.orderBy(F.desc("n"), cluster)), F.row_number().over(Window.orderBy("n", cluster))
    rows = sizes.withColumns({"_ratio": ratio, "_down": down, "_up": up})
    action = F.when((F.col("_ratio") > split_ratio) & (F.col("_down") == 1), "split").when((F.col("_ratio") < merge_ratio) & (F.col("_up") <= 2), "merge").otherwise("keep")
    return rows.select(cluster, "n", action.alias("action"))


def offset_norms(rows: DataFrame, centres: DataFrame, cluster: str, v: str) -> DataFrame:
    """Per cluster: members, mean and largest distance to the centre, inertia."""
    from strandlore.operators.vectors import squared_distance, wide

    joined = rows.join(centres, cluster).withColumn("_d2", squared_distance(wide(v), F.col("centroid")))
    return joined.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(F.sqrt("_d2")).alias("offset_mean"), F.sqrt(F.max("_d2")).alias("offset_max"), F.sum("_d2").alias("inertia"))


def merge_tags(base: Column, more: Column) -> Column:
    """Union of two maps; the second wins."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(more), k)), more)


def export_savings(changed: DataFrame, rows: DataFrame, key: str, cluster: str) -> DataFrame:
    """One row: clusters that an incremental export writes, and the share it leaves out."""
    every = rows.agg(F.count_distinct(cluster).alias("clusters"))
    hit = rows.join(changed.select(key), key, "left_semi").agg(F.count_distinct(cluster).alias("changed_clusters"))
    return every.join(F.broadcast(hit)).select("clusters", "changed_clusters", F.round(1 - F.col("changed_clusters") / F.greatest("clusters", F.lit(1)), 6).alias("saved"))
