"""Session defaults and the one way this library cuts lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strandlore")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in ``spark.checkpoint.dir``; where it is unset, make one in local mode and refuse on a cluster."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strandlore-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, is cleaned when no plan refers to it.

    Use it on narrow tables that are read more than once, never on whole texts.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder, for tables written and read back."""
    import uuid

    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/strandlore-{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable for Python workers that don't have it on their path. Once per application."""
    root = Path(__file__).resolve().parents[1]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    application = spark.sparkContext.applicationId
    if application in _shipped or root in [Path(p).resolve() for p in known if p]:
        return
    _shipped.add(application)
    base = Path(tempfile.mkdtemp(prefix="strandlore-ship-")) / "strandlore"
    spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", root, "strandlore"))
