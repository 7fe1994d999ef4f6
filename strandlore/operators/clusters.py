"""Cluster building and upkeep: fits on samples, splits and merges, silhouettes, compact storage, memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandlore.operators import codecs, vectors as V
from strandlore.session import cut


def build(rows: DataFrame, centres: DataFrame, key: str, cluster: str, v: str) -> DataFrame:
    """Members as offsets from their centre: (cluster, key, offset)."""
    joined = rows.join(centres, cluster)
    return joined.select(cluster, key, F.zip_with(V.wide(v), "centroid", lambda x, c: x - c).alias("offset"))


def restore(members: DataFrame, centres: DataFrame, cluster: str) -> DataFrame:
    return members.join(centres, cluster).withColumn("restored", F.zip_with("offset", "centroid", lambda o, c: o + c))


def fit_on_sample(rows: DataFrame, key: str, v: str, k: int, sample: int, steps: int = 20):
    """Centres from the ``sample`` rows of smallest hash; then every row is assigned."""
    chosen = rows.orderBy(F.xxhash64(F.col(key)), key).limit(sample)
    centres, _ = V.lloyd(chosen, key, v, k, steps)
    return centres, V.assign(rows, centres, key, v, "cluster")


def split(rows: DataFrame, key: str, v: str, mean: list[float]) -> tuple[list[list[float]], DataFrame] | None:
    """Two centres and each member's side (key, nearest): 2-means that starts from the member farthest from the mean
    and the one farthest from that. None if all members are equal."""
    farthest = lambda m: rows.select(wide_v.alias("x"), V.squared_distance(wide_v, F.array(*[F.lit(float(y)) for y in m])).alias("d"), key).orderBy(F.desc("d"), key).first()
    wide_v = V.wide(v)
    first = farthest(mean)
    second = farthest(first["x"])
    if not second["d"]:
        return None
    centres, sides = V.lloyd(rows, key, v, 2, 8, start=[list(first["x"]), list(second["x"])])
    return [list(r["centroid"]) for r in centres.orderBy("cluster").collect()], sides.select(key, "nearest")


def adapt(rows: DataFrame, key: str, v: str, k: int | None = None, split_ratio: float = 5.0, merge_ratio: float = 1.5, steps: int = 8):
    """Splits the largest cluster by 2-means while sizes are far apart, and gives the smallest one to its nearest neighbour
    while they are too alike; starts from k clusters, round(sqrt(rows)) if none is said.

    Only sizes and centres, one a cluster, come to the driver; a step relabels the members of one cluster.
    """
    spark = rows.sparkSession
    k = k or max(2, round(rows.count() ** 0.5))
    centres, placed = V.lloyd(rows, key, v, k, 10)
    means = {r["cluster"]: list(r["centroid"]) for r in centres.collect()}
    placed = cut(placed.select(key, F.col("nearest").cast("int").alias("nearest")))
    for _ in range(steps):
        sizes = {r["nearest"]: r["count"] for r in placed.groupBy("nearest").count().collect()}
        means = {c: means[c] for c in sizes}
        small, big = min(sizes, key=lambda c: (sizes[c], c)), max(sizes, key=lambda c: (sizes[c], -c))
        ratio = sizes[big] / max(1, sizes[small])
        if ratio > split_ratio:
            found = split(rows.join(placed.where(F.col("nearest") == big).select(key), key), key, v, means[big])
            if found is None:
                break
            new = max(means) + 1
            means[big], means[new] = found[0]
            label = F.when(F.col("_side") == 1, F.lit(new)).otherwise(F.col("nearest"))
            placed = cut(placed.join(found[1].withColumnRenamed("nearest", "_side"), key, "left").select(key, label.alias("nearest")))
        elif ratio < merge_ratio and len(sizes) > 2:
            near = min((c for c in means if c != small), key=lambda c: (sum((x - y) ** 2 for x, y in zip(means[c], means[small], strict=True)), c))
            n, m = sizes[near], sizes[small]
            means[near] = [(x * n + y * m) / (n + m) for x, y in zip(means[near], means.pop(small), strict=True)]
            placed = cut(placed.withColumn("nearest", F.when(F.col("nearest") == small, F.lit(near)).otherwise(F.col("nearest"))))
        else:
            break
    order = sorted(means)
    centres = spark.createDataFrame([(i, means[c]) for i, c in enumerate(order)], "cluster int, centroid array<double>")
    names = spark.createDataFrame(list(enumerate(order)), "_new int, nearest int")
    placed = placed.join(F.broadcast(names), "nearest").select(key, F.col("_new").alias("nearest")).join(rows.select(key, v), key)  # a row a cluster
    far = placed.join(F.broadcast(centres), placed["nearest"] == centres["cluster"])
    return centres, far.select(key, "nearest", V.squared_distance(V.wide(v), F.col("centroid")).alias("distance"))


def silhouette(rows: DataFrame, key: str, cluster: str, v: str, sample: int = 2048) -> float | None:
    """Mean silhouette over the rows of smallest hash, a fixed number of them; null with fewer than two clusters."""
    chosen = rows.orderBy(F.xxhash64(F.col(key)), key).limit(sample).select(cluster, V.wide(v).alias("v")).collect()
    label = np.unique([r[cluster] for r in chosen], return_inverse=True)[1] if chosen else np.array([])
    if len(set(label.tolist())) < 2:
        return None
    x = np.array([r["v"] for r in chosen])
    square = (x * x).sum(axis=1)
    far = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0))
    count = np.bincount(label)
    total = np.stack([far[:, label == c].sum(axis=1) for c in range(len(count))], axis=1)
    own = np.arange(len(x)), label
    a = total[own] / np.maximum(count[label] - 1, 1)
    other = total / count
    other[own] = np.inf
    b = other.min(axis=1)
    score = np.where(count[label] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0)
    return float(score.mean())


def compact(members: DataFrame, cluster: str, key: str, offset: str = "offset") -> DataFrame:
    """(cluster, key, scale, codes): offsets as one byte a component, with a step per row; 0 stands at code 128."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch["offset"].to_pylist(), float)
                scale = np.abs(x).max(axis=1) / 127
                scale = np.where(scale > 1e-12, scale, 1.0)
                codes = (np.clip(np.rint(x / scale[:, None]), -127, 127) + 128).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch["cluster"], batch["key"], pa.array(scale.astype(np.float32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["cluster", "key", "scale", "codes"])

    kinds = dict(members.dtypes)
    source = members.select(F.col(cluster).alias("cluster"), F.col(key).alias("key"), F.col(offset).alias("offset"))
    out = source.mapInArrow(run, f"cluster {kinds[cluster]}, key {kinds[key]}, scale float, codes binary")
    return out.withColumnRenamed("cluster", cluster).withColumnRenamed("key", key)


def recall_memory(log: DataFrame, key: str, text: str, query: str, k: int, dims: int = 32) -> DataFrame:
    """The k log entries whose embedding is closest to the query's."""
    asked = F.array(*[F.lit(float(x)) for x in codecs.text_embedding(query, dims)])
    scored = codecs.embed_texts(log, key, text, dims).select(key, F.round(V.dot(V.wide("embedding"), asked), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)
