"""Exact top-k by inner product through a pivot-distance index.

Largest inner product is made nearest neighbour: with M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and
q' = (q, 0), the squared distance is |q|^2 + M^2 - 2 q.x. Pivots are rows of the table. Every vector is
keyed by its nearest pivot and its distance to it; a pivot's vectors, sorted by distance, are cut into
annuli. For a query, the distance to the pivot and an annulus's two radii bound the distance of all
its vectors by the triangle inequality, hence their scores from above. The query starts from the k-th
best score among SAMPLE known rows, which is a lower bound of its k-th best of all, and expands the annuli in
the order of their bounds: one, then GROWTH times as many in each round. After each round the k-th best
score found so far is its floor, and it stops at the first annulus that can't reach it; so results are exact.

Pivots grow with the square root of the rows, up to the sample's size. Annuli are stored as tiles of at most about
TILE vectors, and queries go in groups: a group meets a tile in one matrix product, in which only the k best of each
query stay. Sample, pivots and annulus radii have bounded sizes; all else is distributed.

Defined cases: vectors that are null or hold a null or non-finite component take no part; shorter ones are
as if filled up with zeros; every row is a candidate, also repeated ones and those without an id; a query's own row is
every row with its id; queries that agree in id and vector count once, and those with one id and several vectors share
one result list; ties go to the smaller id, rows without one last; other columns, whatever their names, take no
part; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandlore.llm.common import small_batches
from strandlore.session import cut

#: Rows of the sample, vectors of a tile, queries of a group, annuli of a pivot, annuli of a round to those of the one before.
SAMPLE, TILE, GROUP, RINGS, GROWTH = 2048, 1024, 512, 4, 8
#: Stands for no id, after all others.
NO_ID = 2**63 - 1
KEYED = "vec_id long, v binary, cell int, ring int, dist double"
HITS = "query_id long, vec_id long, score long"


def whole(embedding: str, factor: int = 256) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * factor))


def vectors(df: DataFrame, key: str, embedding: str) -> DataFrame:
    fine = F.col(embedding).isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("vec_id"), whole(embedding).alias("v"))


def _matrix(lists: list, dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


class Geometry:
    """Pivots, radii and the sample: everything of fixed size that both sides need."""

    def __init__(self, sample: list, dims: int, norm2: int, rows: int, k: int):
        self.k, self.dims, self.norm2 = k, dims, float(norm2)
        self.ids = np.array([r["vec_id"] for r in sample], np.int64)
        self.sample = _matrix([r["v"] for r in sample], dims)
        self.rings = RINGS
        #: a component is at most the root of the largest norm
        self.dtype = np.int32 if norm2 < 2**60 else np.int64
        # exact in doubles as long as every sum of products stays below 2 ** 53
        self.safe = dims * max(1, norm2) < 2**53
        self.pivots = self.sample[: math.ceil(math.sqrt(rows) / 8)].astype(float)
        cell, dist = self.place(self.sample)
        self.edges = np.array([np.quantile(dist[cell == c], np.arange(1, self.rings) / self.rings) if (cell == c).any() else np.zeros(self.rings - 1) for c in range(len(self.pivots))]).reshape(len(self.pivots), -1)

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """To the pivots, in the lifted space."""
        lift = lambda v: np.sqrt(np.maximum(self.norm2 - (v * v).sum(axis=1), 0))
        x = x.astype(float)
        extra = np.zeros(len(x)) if query else lift(x)
        p = self.pivots
        d2 = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * x @ p.T + (extra[:, None] - lift(p)[None, :]) ** 2
        return np.sqrt(np.maximum(d2, 0))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(x, query=False)
        cell = d.argmin(axis=1)
        return cell, d[np.arange(len(x)), cell]

    def dot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64) if self.safe else a @ b.T

    def best(self, score: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The k best columns of each row, the first ones on ties; own columns last."""
        n = score.shape[1]
        if n <= self.k or not self.safe or n > 1 << 10:
            return np.argsort(np.where(own, np.iinfo(np.int64).max, -score), axis=1, kind="stable")[:, : self.k]
        # below 2 ** 53, so score and column fit one integer and no two are equal
        order = np.where(own, np.iinfo(np.int64).min, (score << 10) - np.arange(n))
        return np.argpartition(order, n - self.k, axis=1)[:, n - self.k :]

    def floor_scores(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """A score that each query's k-th best is sure to reach."""
        s = self.dot(q, self.sample).astype(float)
        s[ids[:, None] == self.ids[None, :]] = -np.inf
        if s.shape[1] < self.k:
            return np.full(len(q), -np.inf)
        return np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]

    def bounds(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """For each query and annulus, a score that no vector in it exceeds (with room for rounding)."""
        d = self.distances(q, query=True)[:, cells]
        least = np.maximum(np.maximum(d - high[None, :], low[None, :] - d) - 1e-6 * (1 + d), 0)
        q2 = (q.astype(float) ** 2).sum(axis=1)[:, None]
        return (q2 + self.norm2 - least**2) / 2 + 1e-6 * (1 + q2 + self.norm2)


def top_k(df: DataFrame, queries: Column, k: int = 5, *, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score; ``queries`` is a condition on ``vec_id``."""
    spark = df.sparkSession
    small_batches(spark)
    base = cut(vectors(df, key, embedding))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    facts = base.agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("dims"), F.max(norm).alias("norm2")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = cut(base.where(queries & (F.col("vec_id") != NO_ID)).dropDuplicates())
    n_asked = asked.count()
    if not n_asked:
        return empty
    sample = base.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).collect()
    g = Geometry(sample, facts["dims"], facts["norm2"], facts["rows"], k)
    shared = spark.sparkContext.broadcast(g)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        geo = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["v"].to_pylist(), geo.dims)
            cell, dist = geo.place(x)
            ring = (dist[:, None] > geo.edges[cell]).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array([r.tobytes() for r in x.astype(geo.dtype)], pa.binary()), pa.array(cell, pa.int32()), pa.array(ring, pa.int32()), pa.array(dist)],
                names=["vec_id", "v", "cell", "ring", "dist"],
            )

    index = cut(base.mapInArrow(keyed, KEYED))
    radii = index.groupBy("cell", "ring").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count("*").alias("n")).orderBy("cell", "ring").collect()  # SAMPLE * RINGS at most
    plan = spark.sparkContext.broadcast({c: np.array([r[c] for r in radii]) for c in ("cell", "ring", "low", "high")})
    sizes = F.broadcast(spark.createDataFrame([(r["cell"], r["ring"], math.ceil(r["n"] / TILE)) for r in radii], "cell int, ring int, _tiles int"))
    salt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("_tiles")).cast("int")  # also rows of one id are spread
    salted = index.join(sizes, ["cell", "ring"]).withColumn("tile", salt)
    tiles = cut(salted.groupBy("cell", "ring", "tile").agg(F.collect_list(F.struct("vec_id", "v")).alias("members")))  # about TILE each
    asked = asked.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(math.ceil(n_asked / GROUP))))

    def visits_of(first: int, end: int):
        def visits(rows: pd.DataFrame) -> pd.DataFrame:
            """Of each query's annuli by falling bound those from ``first`` to ``end`` that it must see."""
            geo, p = shared.value, plan.value
            ids, q = rows["vec_id"].to_numpy(np.int64), _matrix(rows["v"].tolist(), geo.dims)
            floor = np.maximum(geo.floor_scores(ids, q), rows["floor"].fillna(-np.inf).to_numpy(float))
            bound = geo.bounds(q, p["low"], p["high"], p["cell"])
            turn = np.empty(bound.shape, np.int64)
            np.put_along_axis(turn, np.argsort(-bound, axis=1, kind="stable"), np.arange(bound.shape[1])[None, :], axis=1)
            need = (bound >= floor[:, None]) & (turn >= first) & (turn < end)
            out = [(int(p["cell"][j]), int(p["ring"][j]), ids[n].tobytes(), q[n].astype(geo.dtype).tobytes(), floor[n].tobytes()) for j in range(bound.shape[1]) if (n := need[:, j]).any()]
            return pd.DataFrame(out, columns=["cell", "ring", "qids", "q", "floor"])

        return visits

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        geo = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                qids, q = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["q"], geo.dtype).reshape(-1, geo.dims).astype(np.int64)
                ids = np.array([m["vec_id"] for m in r["members"]], np.int64)
                x = np.frombuffer(b"".join(m["v"] for m in r["members"]), geo.dtype).reshape(-1, geo.dims).astype(np.int64)
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                score = geo.dot(q, x)
                own = qids[:, None] == ids[None, :]
                best = geo.best(score, own)
                i = np.repeat(np.arange(len(q)), best.shape[1])
                j = best.ravel()
                ok = ~own[i, j] & (score[i, j] >= np.frombuffer(r["floor"], np.float64)[i])
                yield pa.RecordBatch.from_arrays([pa.array(qids[i[ok]]), pa.array(ids[j[ok]]), pa.array(score[i, j][ok])], names=["query_id", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = spark.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    first, end = 0, 1
    while first < len(radii):
        floors = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
        seen = asked.join(floors, "vec_id", "left").groupBy("group").applyInPandas(visits_of(first, end), "cell int, ring int, qids binary, q binary, floor binary")
        seen = seen.join(sizes, ["cell", "ring"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
        hits = seen.join(tiles, ["cell", "ring", "tile"]).mapInArrow(scored, HITS)
        best = cut(best.drop("rank").union(hits).withColumn("rank", rank).where(F.col("rank") <= k))
        first, end = end, GROWTH * end + 1
    return best.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
