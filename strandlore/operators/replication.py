"""Replica audits, repair and placement plans, nodes, quorum and consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def fresh(state: Column, last_seen: Column, now: Column, stale_seconds: int) -> Column:
    return (state == "healthy") & (F.unix_timestamp(now) - F.unix_timestamp(last_seen) <= stale_seconds)


def audit(required: DataFrame, replicas: DataFrame, now: Column, stale_seconds: int) -> DataFrame:
    """(blob_id, required, healthy, missing) of under-replicated blobs; ``required``: blob_id, required."""
    healthy = replicas.groupBy("blob_id").agg(F.count_if(fresh(F.col("state"), F.col("last_seen"), now, stale_seconds)).alias("healthy"))
    found = required.join(healthy, "blob_id", "left").withColumn("healthy", F.coalesce("healthy", F.lit(0)))
    return found.where("healthy < required").select("blob_id", "required", "healthy", (F.col("required") - F.col("healthy")).alias("missing"))


def can_delete(required: DataFrame, replicas: DataFrame, owner: str, now: Column, stale_seconds: int) -> DataFrame:
    """Durability gate: an owner's bytes may go only if all its blobs have their replicas elsewhere."""
    healthy = replicas.groupBy("blob_id").agg(F.count_if(fresh(F.col("state"), F.col("last_seen"), now, stale_seconds)).alias("healthy"))
    return required.join(healthy, "blob_id", "left").groupBy(owner).agg(F.bool_and(F.coalesce("healthy", F.lit(0)) >= F.col("required")).alias("can_delete"))


def utilization(used: Column, capacity: Column) -> Column:
    return F.when(capacity <= 0, 1.0).otherwise(used / capacity)


def healthy_nodes(nodes: DataFrame, now: Column, timeout_seconds: int = 60, role: str | None = None) -> DataFrame:
    alive = nodes.where(F.col("status").isin("healthy", "degraded") & (F.unix_timestamp(now) - F.unix_timestamp("last_heartbeat") <= timeout_seconds))
    return alive.where(F.col("role") == role) if role else alive


def least_loaded(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min(F.struct(utilization(F.col("used_gb"), F.col("capacity_gb")).alias("utilization"), "node_id")).alias("n")).select("n.node_id", "n.utilization")


def placements(needs: DataFrame, replicas: DataFrame, nodes: DataFrame, preferred_region: str) -> DataFrame:
    """For each blob the ``missing`` best nodes that don't hold it: preferred region first, then emptiest.

    Node candidates per blob: a blob has at most ``held`` holders, so its targets are among the first
    held + missing nodes of the one global ranking; that prefix, not the node table, meets each blob.
    """
    order = Window.orderBy((F.col("region") != preferred_region).cast("int"), "load", "node_id")
    ranked = nodes.select("node_id", "region", utilization(F.col("used_gb"), F.col("capacity_gb")).alias("load")).withColumn("node_rank", F.row_number().over(order))
    holders = replicas.select("blob_id", "node_id").distinct()
    held = holders.groupBy("blob_id").agg(F.count("*").alias("_held"))
    wanted = needs.join(held, "blob_id", "left").withColumn("node_rank", F.explode(F.sequence(F.lit(1), (F.coalesce("_held", F.lit(0)) + F.col("missing")).cast("int"))))
    free = wanted.join(ranked, "node_rank").join(holders, ["blob_id", "node_id"], "left_anti")
    pick = Window.partitionBy("blob_id").orderBy("node_rank")
    return free.withColumn("choice", F.row_number().over(pick)).where("choice <= missing").select("blob_id", "node_id", "choice")


def repair_steps(needs: DataFrame, replicas: DataFrame, nodes: DataFrame) -> DataFrame:
    """(blob_id, source_id, node_id, step): which node copies to which, for each of the ``missing`` replicas.

    The source is the first node, in the order of ids, that holds the blob in any state; targets are the first ones that
    have no healthy replica. As in ``placements``, a blob meets a prefix of the one ranking, not the table of nodes.
    """
    ranked = nodes.select("node_id").withColumn("node_rank", F.row_number().over(Window.orderBy("node_id")))
    source = replicas.groupBy("blob_id").agg(F.min("node_id").alias("source_id"))
    healthy = replicas.where("state = 'healthy'").select("blob_id", "node_id").distinct()
    held = healthy.groupBy("blob_id").agg(F.count("*").alias("_held"))
    wanted = needs.join(source, "blob_id").join(held, "blob_id", "left")
    wanted = wanted.withColumn("node_rank", F.explode(F.sequence(F.lit(1), (F.coalesce("_held", F.lit(0)) + F.col("missing")).cast("int"))))
    free = wanted.join(ranked, "node_rank").join(healthy, ["blob_id", "node_id"], "left_anti")
    step = F.row_number().over(Window.partitionBy("blob_id").orderBy("node_rank"))
    return free.withColumn("step", step).where("step <= missing").select("blob_id", "source_id", "node_id", "step")


def quorum(acks: DataFrame, key: str, wanted: int) -> DataFrame:
    return acks.groupBy(key).agg(F.count_distinct("node_id").alias("acks")).withColumn("committed", F.col("acks") >= wanted)


def consistency(blobs: DataFrame, healthy: Column, min_replicas: int) -> DataFrame:
    """One row: counts of healthy, corrupt and under-replicated blobs, and the healthy share in percent. (replicas: count column)"""
    corrupt, under = ~healthy, healthy & (F.col("replicas") < min_replicas)
    n = F.count("*")
    good = F.count_if(healthy & ~under)
    return blobs.agg(
        n.alias("total"), good.alias("healthy"), F.count_if(corrupt).alias("corrupt"), F.count_if(under).alias("under_replicated"),
        F.when(n == 0, 100.0).otherwise(F.round(good * 100.0 / n, 4)).alias("healthy_pct"),
    )


def first_source(offers: DataFrame, key: str, priority: str) -> DataFrame:
    """Ordered-fallback fetch: of all sources that have a blob, the first in priority."""
    w = Window.partitionBy(key).orderBy(priority)
    return offers.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
