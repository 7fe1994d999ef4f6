"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most this many narrow rows (tens of MB) may be broadcast after it was counted.
BROADCAST_ROWS = 200_000
SALTS = 16


def small_batches(spark: SparkSession, rows: int = 256, size: int = 16 << 20) -> None:
    """Bound an Arrow batch's rows and bytes, since one row here can hold a very long text."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if int(spark._jsparkSession.sessionState().conf().getConfString(key, str(2**31 - 1)).rstrip("b")) > most:
            spark.conf.set(key, str(most))


def boxed(docs: DataFrame) -> Column:
    """All columns as one struct ``_row``, so that names in it clash with nothing."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def unboxed(docs: DataFrame, **instead: Column) -> list[Column]:
    """The columns of ``docs`` from ``_row``, but for those in ``instead``."""
    return [instead.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]


def lookup_join(rows: DataFrame, small: DataFrame, keys: list[str], spread: Column, n_small: int) -> DataFrame:
    """Left join of ``rows`` to a table with unique keys, where one key may hold a third of the rows.

    Up to BROADCAST_ROWS counted rows are broadcast, so ``rows`` doesn't move. Beyond that both
    sides are shuffled by the key and a salt: a hot key's rows go to SALTS tasks.
    """
    if n_small <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), keys, "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")
