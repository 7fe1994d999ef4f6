"""Histograms, percentile buckets, counters, gauges, span summaries, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Upper bounds of the histogram's buckets; one more takes what lies above.
BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def bucket(value: Column, bounds: list[float] = BOUNDS) -> Column:
    """Index of the first bound that isn't below the value; len(bounds) beyond the last."""
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(value <= bounds[i], i).otherwise(out)
    return out


def histogram(rows: DataFrame, name: str, value: str, bounds: list[float] = BOUNDS) -> DataFrame:
    return rows.groupBy(name, bucket(F.col(value), bounds).alias("bucket")).agg(F.count("*").alias("n"))


def summary(rows: DataFrame, name: str, value: str) -> DataFrame:
    return rows.groupBy(name).agg(
        F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most")
    )


def percentile_bucket(hist: DataFrame, name: str, p: float, bounds: list[float] = BOUNDS) -> DataFrame:
    """Upper bound of the first bucket whose cumulated count reaches ``p``; the last bound for the overflow."""
    every = hist.select(name).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))))
    full = every.join(hist, [name, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(name)
    running = full.withColumn("_run", F.sum("n").over(w.orderBy("bucket"))).withColumn("_all", F.sum("n").over(w))
    first = running.where(F.col("_run") >= F.col("_all") * p).groupBy(name).agg(F.min("bucket").alias("_b"))
    return first.select(name, F.element_at(F.array(*[F.lit(b) for b in bounds]), F.least("_b", F.lit(len(bounds) - 1)) + 1).alias("percentile"))


def counters_and_gauges(rows: DataFrame, name: str, value: str, seq: str) -> DataFrame:
    return rows.groupBy(name).agg(F.round(F.sum(value), 4).alias("counter"), F.max(F.struct(seq, value))[value].alias("gauge"))


def order_statistics(rows: DataFrame, key: str, value: str, index: dict[str, Column]) -> DataFrame:
    """(key, a column per entry of ``index``): the value at a zero-based place in the key's sorted values.

    ``index`` maps a name to a place in terms of the key's row count ``n``. Values fall into monotone
    buckets, whose counts find the bucket of each place; only that bucket's distinct values are
    then ordered. A key may hold any number of rows, and one value any part of them.
    """
    v = F.col(value)
    rows = rows.where(v.isNotNull()).select(key, v.alias("_v"), (F.signum(v) * F.floor(F.log2(1 + F.abs(v)) * 256)).alias("_b"))
    counts = rows.groupBy(key, "_b").agg(F.count("*").alias("_c"))
    until = F.sum("_c").over(Window.partitionBy(key).orderBy("_b"))
    places = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at.cast("long").alias("at")) for name, at in index.items()]))
    # a few thousand buckets a key
    wanted = counts.withColumn("_until", until).withColumn("n", F.sum("_c").over(Window.partitionBy(key))).withColumn("_p", places)
    wanted = wanted.where((F.col("_p.at") < F.col("_until")) & (F.col("_p.at") >= F.col("_until") - F.col("_c")))
    wanted = wanted.select(key, "_b", F.col("_p.name").alias("_name"), (F.col("_p.at") - F.col("_until") + F.col("_c")).alias("_at"))
    within = rows.join(wanted, [key, "_b"]).groupBy(key, "_name", "_at", "_v").agg(F.count("*").alias("_c"))
    reached = within.withColumn("_until", F.sum("_c").over(Window.partitionBy(key, "_name").orderBy("_v"))).where(F.col("_until") > F.col("_at"))
    return reached.groupBy(key).agg(*[F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in index])


def span_summary(spans: DataFrame, operation: str, duration: str, failed: Column) -> DataFrame:
    """Count, mean, extremes, index-based median and 95th percentile, errors, per operation."""
    n = F.col("n")
    ranks = order_statistics(spans, operation, duration, {"p50": F.floor(n / 2), "p95": F.least(F.floor(n * F.lit(0.95)), n - 1)})
    facts = spans.groupBy(operation).agg(
        F.count("*").alias("n"), F.round(F.avg(duration), 4).alias("mean"), F.min(duration).alias("least"), F.max(duration).alias("most"), F.count_if(failed).alias("errors")
    )
    return facts.join(ranks, operation)


def worst(severity: Column) -> Column:
    """Overall health: the worst component wins (0 healthy, 1 degraded, 2 unhealthy)."""
    return F.when(F.max(severity) == 2, "unhealthy").when(F.max(severity) == 1, "degraded").otherwise("healthy")
