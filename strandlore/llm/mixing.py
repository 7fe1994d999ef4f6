"""Mixing sources to target weights by systematic sampling. DataFrame operations only.

Within a source every document's expected number of copies is ``rate`` = target / source size.
Documents stand in one order per source (size class, then a hash), the expected copies are
prefix-summed along it, one offset per source is added, and a document is emitted once for each
integer that its stretch of the sum crosses. Because the order runs through the size classes, the
words taken follow the target closely, and because a rate is at most ``cap``, no document is
emitted more than ``cap`` times.

A prefix sum over a source must not be one task's work. The order is cut into cells (size class,
and two levels of hash digits); counts are summed upwards level by level, prefix sums run over at
most 64 siblings (size classes: a few hundred) and only the last step numbers the rows of one cell.

Defined cases: null text has size 0 and is never emitted; a null source is a source of its own,
after all others; equal rows are numbered one after the other, so that of m equal rows any may be
the one that is emitted; a very long text is one size class like any other; columns of the input whose names clash with
working columns are kept apart in one struct; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandlore.llm.common import WORD, boxed, unboxed
from strandlore.session import cut

LEVELS = ["_src", "_class", "_b1", "_b2"]


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def placed(docs: DataFrame, seed: int) -> DataFrame:
    """Adds size, the cell and the order within the cell; keeps all columns."""
    bits = F.length(F.bin("_size"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    digits = lambda at, n: F.conv(F.substring("_key", at, n), 16, 10).cast("int")
    return (
        docs.withColumn("_size", word_count("text"))
        .withColumn("_src", F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")))
        .withColumn("_class", bits * 16 + F.expr("shiftright(_size, greatest(length(bin(_size)) - 4, 0))").cast("int"))
        .withColumn("_key", key)
        .withColumn("_b1", F.shiftright(digits(1, 2), 2))
        .withColumn("_b2", F.shiftright(digits(3, 2), 2))
        .withColumn("_tie", F.xxhash64("text"))
    )


def targets(sources: DataFrame, weights: tuple[int, ...], share: tuple[int, int], cap: int) -> DataFrame:
    """Target and rate per source from (_src, _words): shares by weight, stopped at ``cap`` times the size.

    Resharing the excess until no source is above its stop ends in one water level: with sources by
    rising stop / weight, the stopped ones are those whose ratio lies below the level that is left
    when all before them are stopped. The table has one row per source.
    """
    order = Window.orderBy("_src")
    whole = Window.partitionBy()
    fill = Window.orderBy("_ratio", "_src")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    table = (
        sources.withColumn("_w", weight.cast("long"))
        .withColumn("_stop", F.col("_words") * cap)
        .withColumn("_ratio", F.col("_stop").cast("double") / F.col("_w"))
        .withColumn("_left", F.sum("_words").over(whole) * share[0] - F.coalesce(F.sum("_stop").over(before), F.lit(0)) * share[1])
        .withColumn("_open", F.sum("_w").over(after) * share[1])
        .withColumn("_stopped", F.col("_stop") * F.col("_open") <= F.col("_left") * F.col("_w"))
    )
    table = table.withColumn("_n", F.row_number().over(fill))
    first_open = F.min(F.when(~F.col("_stopped"), F.struct("_n", "_left", "_open"))).over(whole)
    target = F.when(F.col("_stopped"), F.col("_stop").cast("double")).otherwise(
        (F.col("_w") * F.col("_first._left")).cast("double") / F.col("_first._open").cast("double")
    )
    return (
        table.withColumn("_first", first_open)
        .withColumn("_target", target)
        .select("_src", "_words", "_target", F.when(F.col("_words") > 0, F.col("_target") / F.col("_words")).otherwise(0.0).alias("_rate"))
    )


def cells(rows: DataFrame, weights: tuple[int, ...], share: tuple[int, int], cap: int, seed: int) -> DataFrame:
    """One row per cell: rows of its source that stand before it, and its source's figures."""
    finest = cut(rows.groupBy(*LEVELS).agg(F.count("*").alias("_n"), F.sum("_size").alias("_s")))
    found = finest.select(*LEVELS)
    for depth in (4, 3, 2):
        keys = LEVELS[:depth]
        before = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        level = finest.groupBy(*keys).agg(F.sum("_n").alias("_n")).withColumn(f"_p{depth}", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        found = found.join(level, keys)
    sources = targets(finest.groupBy("_src").agg(F.sum("_s").alias("_words")), weights, share, cap)
    offset = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("offset"), "_src")), 1, 5), 16, 10).cast("double") + 0.5) / 1048576.0
    return found.join(sources.withColumn("_u", offset), "_src").withColumn("_before", F.col("_p2") + F.col("_p3") + F.col("_p4")).drop("_p2", "_p3", "_p4")


def with_copies(rows: DataFrame, table: DataFrame, cap: int) -> DataFrame:
    """Adds ``_copies``; rows and cells meet on the cell, which no hot source or size fills alone."""
    order = Window.partitionBy(*LEVELS).orderBy("_key", "doc_id", "_size", "_tie")
    at = F.col("_before") + F.col("_nth")
    crossed = F.floor(F.col("_u") + F.col("_rate") * at) - F.floor(F.col("_u") + F.col("_rate") * (at - 1))
    return rows.withColumn("_nth", F.row_number().over(order)).join(table, LEVELS).withColumn("_copies", F.least(crossed, F.lit(cap)).cast("int"))


def mix_report(docs: DataFrame, weights=(3, 1, 2), share=(3, 2), cap: int = 2, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document. Texts never leave the scan."""
    rows = cut(placed(docs.select("doc_id", "text", "source"), seed).drop("text"))
    out = with_copies(rows, cells(rows, weights, share, cap, seed), cap)
    return out.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_words").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
        F.col("_copies").alias("copies"),
    )


def mix_documents(docs: DataFrame, weights=(3, 1, 2), share=(3, 2), cap: int = 2, seed: int = 7) -> DataFrame:
    """The mixed documents themselves: each as often as it is taken, with the columns of ``docs``.

    The first scan counts cells; the second carries the texts through one shuffle by cell.
    """
    table = cells(placed(docs.select("doc_id", "text", "source"), seed).drop("text"), weights, share, cap, seed)
    rows = placed(docs.select(boxed(docs), "doc_id", "text", "source"), seed).drop("text", "source")
    out = with_copies(rows, table, cap).where(F.col("_copies") > 0)
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*unboxed(docs))
