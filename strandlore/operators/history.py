"""Lineage digests and chains, checkpoints, retention, artifacts, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandlore.session import cut


def canonical_kind(tag: Column, *parts: Column) -> Column:
    return F.concat_ws(":", tag, *parts)


def lineage_digest(edges: DataFrame, origin: str, edge_id: str, kind: Column, cutoff: Column | None = None) -> DataFrame:
    """sha256 over the origin's edges in the order of their ids, whatever order they came in."""
    rows = edges if cutoff is None else edges.where(cutoff)
    line = F.struct(F.col(edge_id).alias("id"), F.concat_ws("|", F.col(edge_id), kind).alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(line)), lambda e: e["line"])
    return rows.groupBy(origin).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("digest"), F.count("*").alias("n_edges"))


def verify_proofs(shares: DataFrame, edges: DataFrame, origin: str, edge_id: str, kind: Column, cutoff: Column | None = None) -> DataFrame:
    """(origin, valid): is the ``proof`` that a share recorded the digest of its origin's edges before the cutoff?"""
    now = lineage_digest(edges, origin, edge_id, kind, cutoff)
    return shares.join(now, origin, "left").select(origin, F.coalesce(F.col("proof") == F.col("digest"), F.lit(False)).alias("valid"))


def chain(nodes: DataFrame) -> DataFrame:
    """Whole parent chains of ``nodes`` (node_id, parent_id), up to the roots: (node_id, ancestor_id, depth).

    Pointer doubling: rounds grow with the logarithm of the longest chain. Fails if parents make a cycle.
    """
    n = nodes.count()
    up = cut(nodes.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("depth")))
    jump = cut(nodes.where(F.col("parent_id").isNotNull()).select(F.col("node_id").alias("_from"), F.col("parent_id").alias("_to")))
    far = 1
    while jump.limit(1).count():
        if far > n:
            raise ValueError("the parents make a cycle")
        higher = up.join(jump, up["ancestor_id"] == jump["_from"]).select("node_id", F.col("_to").alias("ancestor_id"), (F.col("depth") + far).alias("depth"))
        up = cut(up.union(higher))
        on = jump.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        jump = cut(jump.join(on, "_to").select("_from", F.col("_next").alias("_to")))
        far *= 2
    return up


def latest_by_insertion(rows: DataFrame, key: str, seq: str, *columns: str) -> DataFrame:
    """The row inserted last, which isn't the one of the highest step."""
    return rows.groupBy(key).agg(F.max(F.struct(seq, *columns)).alias("r")).select(key, f"r.{seq}", *[f"r.{c}" for c in columns])


def last_of_each(rows: DataFrame, key: str, order: list[Column], keep: int) -> DataFrame:
    """The last ``keep`` rows of each key. A limit per group is applied before the shuffle, so a hot key sends few rows."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


def keep_last(rows: DataFrame, key: str, row_id: str, order: list[Column], keep: int) -> DataFrame:
    """``stays`` per row: among the last ``keep`` of its key. Rows meet the kept ones on their own id, which no key skews."""
    kept = last_of_each(rows, key, order, keep).select(row_id, F.lit(True).alias("stays"))
    return rows.join(kept, row_id, "left").withColumn("stays", F.coalesce("stays", F.lit(False)))


def retention(artifacts: DataFrame, now: Column, keep: int, max_age_seconds: int | None, protected: Column) -> DataFrame:
    """Artifacts to delete: beyond the last ``keep`` of their origin, not protected, and old enough. (artifact_id, origin_id, created_at)"""
    kept = last_of_each(artifacts, "origin_id", [F.desc("created_at"), F.desc("artifact_id")], keep)
    rows = artifacts.where(~protected)
    if max_age_seconds is not None:
        rows = rows.where(F.unix_timestamp(now) - F.unix_timestamp("created_at") > max_age_seconds)
    return rows.join(kept.select("artifact_id"), "artifact_id", "left_anti")


def metric_diff(old: DataFrame, new: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """Metrics that both have, with the difference."""
    a = old.select(key, name, F.col(value).alias("old_value"))
    return a.join(new.select(key, name, F.col(value).alias("new_value")), [key, name]).withColumn("delta", F.col("new_value") - F.col("old_value"))


def artifact_stats(artifacts: DataFrame, kind: str, raw: str, stored: str) -> DataFrame:
    """Count and sizes by type, and in total (null type)."""
    return artifacts.groupingSets([[F.col(kind)], []], F.col(kind)).agg(
        F.count("*").alias("n"), F.sum(raw).alias("raw_bytes"), F.sum(stored).alias("stored_bytes"), F.round(1 - F.sum(stored) / F.sum(raw), 6).alias("saved")
    )


def find_artifacts(artifacts: DataFrame, kind: str | None = None, tags: dict[str, str] | None = None, name_contains: str | None = None) -> DataFrame:
    """Type equal, name contains (any case), all tags equal. (artifact_type, name, tags map)"""
    out = artifacts if kind is None else artifacts.where(F.col("artifact_type") == kind)
    if name_contains is not None:
        out = out.where(F.lower("name").contains(name_contains.lower()))
    for k, v in (tags or {}).items():
        out = out.where(F.col("tags")[k] == v)
    return out


def first_seen(rows: DataFrame, content: str, seq: str) -> DataFrame:
    """``deduped``: the same content was stored before. ``seq`` is unique; rows meet the firsts on it, so much-copied content is no hot key."""
    first = rows.groupBy(content).agg(F.min(seq).alias(seq)).select(seq, F.lit(False).alias("deduped"))
    return rows.join(first, seq, "left").withColumn("deduped", F.coalesce("deduped", F.lit(True)))


def import_summary(rows: DataFrame, owner: str, content: list[str], seq: str, size: str) -> DataFrame:
    """Stored and deduped puts and bytes per owner: the first of equal contents is stored. Two levels of partial sums, no window."""
    each = rows.groupBy(owner, *content).agg(F.count("*").alias("_n"), F.sum(size).alias("_raw"), F.min(F.struct(seq, size))[size].alias("_first"))
    return each.groupBy(owner).agg(
        F.count("*").alias("stored"), (F.sum("_n") - F.count("*")).alias("deduped"), F.sum("_raw").cast("long").alias("raw_bytes"), F.sum("_first").cast("long").alias("stored_bytes")
    )


def reuse(stages: DataFrame, done: DataFrame) -> DataFrame:
    """For each (stage, config_hash): was this very configuration finished before?"""
    marked = done.select("stage", "config_hash", F.lit(True).alias("_done")).distinct()
    return stages.join(marked, ["stage", "config_hash"], "left").withColumn("reuse", F.coalesce("_done", F.lit(False))).drop("_done")
