"""Reference counts, access records, tiers, garbage collection, pins and tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def floored_counts(events: DataFrame, key: str, delta: str, order: list[str], span: Column | None = None) -> DataFrame:
    """Counts that never fall below zero, though each decrement is applied in order.

    Closed form of the fold max(0, count + delta): last sum less the least prefix sum below zero. A
    key's events are cut by ``span``, a value that rises with the order (a day, say): prefix sums run
    within a span, and a key's spans are combined from their sums and least prefix sums. So a hot
    key's events are many tasks' work. Without a span a key is one window.
    """
    rows = events.select(key, delta, *[c for c in order if c != key], (F.lit(0) if span is None else span).alias("_span"))
    w = Window.partitionBy(key, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.withColumn("_sum", F.sum(delta).over(w)).groupBy(key, "_span").agg(F.sum(delta).alias("_total"), F.min("_sum").alias("_least"))
    before = F.coalesce(F.sum("_total").over(Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lowest = F.least(F.lit(0), F.min(F.col("_before") + F.col("_least")))
    return spans.withColumn("_before", before).groupBy(key).agg((F.sum("_total") - lowest).cast("long").alias("ref_count"))


def access_records(accesses: DataFrame, key: str, at: str) -> DataFrame:
    return accesses.groupBy(key).agg(F.count("*").alias("access_count"), F.min(at).alias("first_accessed_at"), F.max(at).alias("last_accessed_at"))


def tier(count: Column, idle_seconds: Column, hot_count: int = 10, hot_seconds: int = 24 * 3600, cold_seconds: int = 7 * 24 * 3600) -> Column:
    """Hot if used often or just now, cold if idle for long, warm between."""
    return F.when(idle_seconds >= cold_seconds, "cold").when((count >= hot_count) & (idle_seconds <= hot_seconds), "hot").otherwise("warm")


def gc_plan(origins: DataFrame, counts: DataFrame, pins: DataFrame, now: Column, grace_seconds: int = 0) -> DataFrame:
    """Origins to collect: no references, no pin that isn't released (pending ones hold too), lifetime over.

    ``origins``: origin_id, created_at, ttl_seconds (null: none needed); ``counts``: origin_id, ref_count; ``pins``: origin_id, state.
    """
    held = pins.where("state <> 'released'").select("origin_id").distinct()
    return (
        origins.join(counts, "origin_id", "left")
        .where(F.coalesce("ref_count", F.lit(0)) == 0)
        .join(held, "origin_id", "left_anti")
        .where(F.col("ttl_seconds").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("created_at") >= F.col("ttl_seconds") + grace_seconds))
        .select("origin_id")
    )


def gc_execute(blobs: DataFrame, plan: DataFrame, key: str, reason: str = "gc") -> tuple[DataFrame, DataFrame]:
    """(tombstones, blobs that stay); tombstones are to be written first."""
    stones = plan.select(F.sha2(F.concat(F.lit("tombstone:"), F.col(key).cast("string")), 256).alias("tombstone_id"), key, F.lit(reason).alias("reason"))
    return stones, blobs.join(plan.select(key), key, "left_anti")


def release_once(releases: DataFrame, by: list[str]) -> DataFrame:
    """Release events, each kind and id once: releasing twice must not decrement twice."""
    return releases.dropDuplicates(by)


def tombstone_releases(representations: DataFrame, tombstoned: DataFrame, key: str, blob: str) -> DataFrame:
    """-1 per blob reference of the tombstoned origins."""
    return representations.join(tombstoned.select(key).distinct(), key, "left_semi").groupBy(blob).agg((-F.count("*")).alias("delta"))


def unreferenced(candidates: DataFrame, references: DataFrame, key: str) -> DataFrame:
    return candidates.join(references.select(key).distinct(), key, "left_anti")


def latest_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Upsert semantics: the last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The new rows whose key is unknown, once each."""
    return new.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")


def eviction_order(entries: DataFrame, keep: int) -> DataFrame:
    """Entries to evict so that ``keep`` stay: never pinned ones; rarest first, then longest unused. (entry, uses, last_use, pinned)

    Positions are global: classes (use count, hour of last use) are counted and prefix-summed, entries
    are numbered within their class, so that no task sorts all of them.
    """
    loose = entries.where(~F.col("pinned")).withColumn("_hour", F.date_trunc("hour", "last_use"))
    sizes = loose.groupBy("uses", "_hour").agg(F.count("*").alias("_n"))
    before = Window.orderBy("uses", "_hour").rowsBetween(Window.unboundedPreceding, -1)
    totals = entries.agg(F.count("*").alias("_all"))  # one row
    within = F.row_number().over(Window.partitionBy("uses", "_hour").orderBy("last_use", "entry"))
    placed = loose.withColumn("_nth", within).join(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), ["uses", "_hour"])
    return placed.join(F.broadcast(totals)).where(F.col("_before") + F.col("_nth") <= F.col("_all") - keep).select("entry", "uses", "last_use", (F.col("_before") + F.col("_nth")).alias("eviction_rank"))


def idle_steps(activity: DataFrame, key: str, step: str, patience: int) -> DataFrame:
    """Steps of the log after each key's last one: (key, streak, prune). No grid of keys and steps.

    The log's steps are numbered (a table of one row a step); keys are aggregated to their last step first.
    """
    steps = activity.select(step).distinct().withColumn("_after", F.row_number().over(Window.orderBy(F.desc(step))) - 1)
    last = activity.groupBy(key).agg(F.max(step).alias(step))
    streak = F.col("_after").cast("long")
    return last.join(steps, step).select(key, streak.alias("streak"), (streak >= patience).alias("prune"))


def zero_streaks(activity: DataFrame, key: str, batch: str, active: str, patience: int) -> DataFrame:
    """Current run of inactive batches per key, and whether it is long enough to prune."""
    w = Window.partitionBy(key).orderBy(F.desc(batch)).rowsBetween(Window.unboundedPreceding, 0)
    seen = activity.withColumn("_later", F.sum(F.col(active).cast("int")).over(w))
    streak = F.sum((F.col("_later") == 0).cast("int"))
    return seen.groupBy(key).agg(streak.alias("streak")).withColumn("prune", F.col("streak") >= patience)
