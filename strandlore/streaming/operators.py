"""Structured Streaming versions of the incremental operators.

Each takes a streaming (or batch) DataFrame with an event-time column and returns the transformed
one; sinks are the caller's. Windows, puts, heartbeats and chunks are let go by watermarks or timeouts.
``access_counters`` and ``zero_streaks`` keep one narrow row a key for good, since a total and a streak have no end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandlore.operators.observability import BOUNDS, bucket


def timed(rows: DataFrame, at: str, late: str) -> DataFrame:
    """With a watermark; event times without a zone are taken in the session's."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def access_counters(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Running count, first and last access per key (update mode)."""
    return timed(events, at, late).groupBy(key).agg(F.count("*").alias("access_count"), F.min(at).alias("first_accessed_at"), F.max(at).alias("last_accessed_at"))


def windowed_histogram(events: DataFrame, name: str, value: str, at: str, width: str = "1 day", late: str = "1 hour", bounds: list[float] = BOUNDS) -> DataFrame:
    """Histogram per tumbling window; final once the watermark has passed it (append mode)."""
    rows = timed(events, at, late).groupBy(F.window(at, width).alias("w"), name, bucket(F.col(value), bounds).alias("bucket")).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), name, "bucket", "n")


def idempotent_puts(puts: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each id once within the watermark: a repeated put does nothing."""
    return timed(puts, at, late).dropDuplicatesWithinWatermark([key])


def zero_streaks(activity: DataFrame, key: str, batch: str, active: str, patience: int) -> DataFrame:
    """Length of each key's present run of inactive batches; emitted per micro-batch in which the key occurs."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(batch, kind="stable")
        for on in rows[active]:
            streak = 0 if on else streak + 1
        state.update((int(streak),))
        yield pd.DataFrame({key: [k[0]], "streak": [streak], "prune": [streak >= patience]})

    kind = dict(activity.dtypes)[key]
    return activity.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, streak long, prune boolean", "streak long", "update", GroupStateTimeout.NoTimeout)


def heartbeats(beats: DataFrame, node: str, at: str, timeout_ms: int = 60_000, late: str = "0 seconds") -> DataFrame:
    """``alive`` when a node reports, ``unreachable`` once the watermark is a timeout past its last report."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({node: [k[0]], "status": ["unreachable"], "last_ms": [last]})
            return
        last = max([state.get[0] if state.exists else 0, *(int(p[at].max().timestamp() * 1000) for p in parts)])
        state.update((last,))
        state.setTimeoutTimestamp(max(last + timeout_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({node: [k[0]], "status": ["alive"], "last_ms": [last]})

    kind = dict(beats.dtypes)[node]
    rows = timed(beats, at, late).select(node, at)
    return rows.groupBy(node).applyInPandasWithState(step, f"{node} {kind}, status string, last_ms long", "last_ms long", "update", GroupStateTimeout.EventTimeTimeout)


def chunk_accumulator(data: DataFrame, key: str, order: str, payload: str, size: int, at: str, idle_ms: int = 60_000, late: str = "0 seconds") -> DataFrame:
    """Emits a chunk whenever ``size`` bytes have come together; the rest waits in the state, and is the last chunk
    of a key for which nothing came until the watermark was ``idle_ms`` past its last row."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, rest, last = state.get if state.exists else (0, b"", 0)
        if state.hasTimedOut:
            state.remove()
            if rest:
                yield pd.DataFrame({key: [k[0]], "ordinal": [number], "chunk": [bytes(rest)]})
            return
        parts = list(parts)
        last = max([last, *(int(p[at].max().timestamp() * 1000) for p in parts)])
        buffer = bytes(rest) + b"".join(pd.concat(parts).sort_values(order, kind="stable")[payload])
        full = len(buffer) // size
        state.update((number + full, buffer[full * size :], last))
        state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * full, "ordinal": list(range(number, number + full)), "chunk": [buffer[i * size : (i + 1) * size] for i in range(full)]})

    kind = dict(data.dtypes)[key]
    rows = timed(data, at, late).select(key, order, payload, at)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ordinal long, chunk binary", "number long, rest binary, last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def flush_latest(updates: DataFrame, path: str, key: list[str], order: list[str], checkpoint: str, trigger: dict | None = None):
    """Write-back: every micro-batch is a flush of the latest row per key, as one more file set; readers take the last."""
    from strandlore.operators.lifecycle import latest_wins

    def flush(batch: DataFrame, number: int) -> None:
        # a replayed batch overwrites its own folder, so a flush counts once
        latest_wins(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
