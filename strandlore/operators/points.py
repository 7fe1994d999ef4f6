"""Exact nearest neighbours among points of whole coordinates, by cells of a grid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandlore.session import cut


def _cells(points: DataFrame, levels: list[int], axes: list[str], low: int) -> DataFrame:
    """A row for each point ``p`` and level: its cell ``_c0.._cn``, of edge 2 ** level."""
    levelled = points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    return levelled.withColumns({f"_c{i}": F.expr(f"shiftright(p.`{a}` - {low}, _level)") for i, a in enumerate(axes)})


def nearest(rows: DataFrame, asked: Column, k: int, distance: Callable[[Column, Column], Column], axes: list[str], kind: str, low: int, bits: int, power: int) -> DataFrame:
    """(query_id, item_id, distance, rank): for every asked row the k nearest of all rows, ties to smaller ids.

    ``rows``: item_id and a struct p of whole ``axes``, each from ``low`` to less than low + 2 ** bits, and its ``kind``.
    ``distance(a, b)`` is the sum of |difference| ** power (1 or 2) over the axes, and no less where kinds differ.
    A point without an axis is at a distance of null, which sorts last; so do null ids.

    Only the k smallest ids of a place can be among the k nearest. The smallest cell around a place that has k rows
    of its kind bounds the distance of the k-th; only the cells that this bound reaches are looked at, so no place meets all rows.
    """
    rows = cut(rows.select("item_id", "p"))
    known = F.lit(True)
    for a in axes:
        known = known & F.col(f"p.`{a}`").isNotNull()
    by_id = F.col("item_id").asc_nulls_last()
    nth = F.row_number().over(Window.partitionBy("p").orderBy(by_id))
    points = cut(rows.where(known).withColumn("_n", nth).where(F.col("_n") <= k).drop("_n"))
    queries = rows.where(asked).select(F.col("item_id").alias("query_id"), "p")
    places = queries.where(known).select("p").distinct()

    cell = ["_level", *[f"_c{i}" for i in range(len(axes))]]
    kinds = F.col(f"p.`{kind}`").alias("_kind")
    levels = list(range(bits + 1))
    full = _cells(points, levels, axes, low).groupBy(kinds, *cell).agg(F.count("*").alias("_n")).where(F.col("_n") >= k).drop("_n")
    least = _cells(places, levels, axes, low).withColumn("_kind", kinds).join(full, ["_kind", *cell]).groupBy("p").agg(F.min("_level").alias("_least"))
    places = places.join(least, "p", "left")
    within = len(axes) * F.pow(F.expr("shiftleft(1L, _least)") - 1, F.lit(power))
    reach = within if power == 1 else F.sqrt(within)
    # where no cell has k rows of one kind, all are looked at
    places = places.withColumns({
        "_level": F.least(F.coalesce(F.col("_least") + 1, F.lit(bits)), F.lit(bits)),
        "_within": F.coalesce(within.cast("long"), F.lit((1 << 62) - 1)),
        "_reach": F.coalesce(F.floor(reach), F.lit(1 << bits)).cast("int"),
    })
    places = cut(places.drop("_least"))
    used = sorted(r["_level"] for r in places.select("_level").distinct().collect())  # bits + 1 at most

    looked, gaps = places, F.lit(0).cast("long")
    for i, a in enumerate(axes):
        at = f"(p.`{a}` - {low})"
        first, last = f"shiftright(greatest({at} - _reach, 0), _level)", f"shiftright(least({at} + _reach, {(1 << bits) - 1}), _level)"
        looked = looked.withColumn(f"_c{i}", F.explode(F.expr(f"sequence({first}, {last})")))
        gap = F.expr(f"greatest(0L, shiftleft(cast(_c{i} AS long), _level) - {at}, {at} - shiftleft(cast(_c{i} AS long) + 1, _level) + 1)")
        gaps = gaps + (gap if power == 1 else gap * gap)
    looked = looked.where(gaps <= F.col("_within")).select(*cell, F.col("p").alias("_q"), "_within")
    met = looked.join(_cells(points, used, axes, low), cell).withColumn("distance", distance(F.col("_q"), F.col("p")))
    best = F.row_number().over(Window.partitionBy("_q").orderBy("distance", by_id))
    found = met.where(F.col("distance") <= F.col("_within")).select("_q", "item_id", "distance").withColumn("_n", best).where(F.col("_n") <= k).drop("_n")
    found = found.withColumnRenamed("_q", "p")

    out = queries.where(known).join(found, "p").select("query_id", "item_id", "distance")
    for of, others in ((known, rows.where(~known)), (~known, rows)):
        ids = [r["item_id"] for r in others.orderBy(by_id).limit(k).collect()] if rows.where(~known).limit(1).count() else []
        if ids:
            last = F.explode(F.array(*[F.lit(i) for i in ids]).cast(f"array<{rows.schema['item_id'].dataType.simpleString()}>"))
            out = out.unionByName(queries.where(of).select("query_id", last.alias("item_id"), F.lit(None).cast(found.schema["distance"].dataType).alias("distance")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), by_id))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)
