"""Pieces that several operators share: tables in the shared folder, Arrow helpers, limits."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import make_importable

#: Rows of one Arrow batch; bounds what a Python worker holds of very long texts at once.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, read by Spark (any file system)."""
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch size if the session allows larger batches than ``BATCH_ROWS``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "tidemark-shared")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written into the shared folder, to cut lineage; ``drop`` removes one that is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
        self.made = 0
        self.saved: list[str] = []

    def save(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = f"{self.root}/{self.made}"
        self.made += 1
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        self.saved.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_tidemark_path", None):
            self._delete(path)

    def keep_only(self, *read: DataFrame) -> None:
        """Drop every table but those that the result still reads."""
        still = {getattr(df, "_tidemark_path", None) for df in read}
        for path in [p for p in self.saved if p not in still]:
            self._delete(path)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.saved = [p for p in self.saved if p != path]


def map_batches(df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` over small batches, for functions of one batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = per_batch(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text only, a null text as an empty one; other columns never reach the operator."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def private(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def file_bytes(path: str, most: int = 64 << 20) -> bytes:
    """A vocabulary file, read on the driver to be sent along; refused beyond ``most`` bytes."""
    size = os.path.getsize(path)
    if size > most:
        raise ValueError(f"{path}: {size} bytes; a vocabulary file of at most {most} is sent to the executors")
    with open(path, "rb") as f:
        return f.read()


_KEPT: dict = {}


def kept(key, make: Callable):
    """An object that a Python worker makes once and keeps for its later tasks.

    Only the last one is kept: workers outlive a stage, and the caches of
    earlier stages would add up.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]
