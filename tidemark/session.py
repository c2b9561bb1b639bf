"""Sessions with the settings the operators count on."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for local sessions that name none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or tempfile.gettempdir()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the shared folder from then on, in the same partitions and order."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    make_importable(df.sparkSession)
    return df.checkpoint()


def make_importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, whatever their working folder is."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def local_session(name: str = "tidemark", cpus: int | None = None, partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass a session of your own."""
    n = cpus or os.cpu_count() or 1
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
