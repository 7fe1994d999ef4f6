"""The driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of whole texts, where a row is much work.
TEXTS = {"documents", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan; Catalyst prunes columns and pushes filters into it. Texts are dealt to all cores first, if their
    scan has fewer tasks than there are cores, as that of one small file has."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in TEXTS:
        return rows
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows
