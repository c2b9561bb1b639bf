"""Raw mono samples (little-endian float32) as a batch source whose partitions are byte ranges of files.

``spark.read.format("raw_samples").option("path", ...).load()`` gives (file, idx,
value).  A file of any length is read by as many tasks as it has ranges, each
holding one block at a time; a window of seconds is turned into the bytes it
needs, so the rest of a file is never read.  Paths are opened by pyarrow's file
systems, on the driver to list them and in the tasks to read them: local and
mounted folders, S3, GCS and HDFS.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WIDTH = 4  #: bytes of a sample
RANGE = 32 << 20  #: bytes a task reads at most, unless the option ``range`` says otherwise
BLOCK = 1 << 20  #: bytes held at once


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    stop: int


def _opened(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class SampleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        rate = float(options.get("rate", "0"))
        start, duration = float(options.get("start", "0")), options.get("duration")
        if (start or duration) and rate <= 0:
            raise ValueError("a window in seconds needs the option rate")
        self.low = int(start * rate)
        self.high = None if duration is None else self.low + int(float(duration) * rate)
        self.size = max(WIDTH, int(options.get("range", str(RANGE))) // WIDTH * WIDTH)

    def partitions(self) -> list[ByteRange]:
        from pyarrow import fs

        system, where = _opened(self.path)
        found = system.get_file_info(where)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == fs.FileType.File else sorted((x for x in system.get_file_info(fs.FileSelector(where, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))), key=lambda x: x.path)
        out = []
        for file in files:
            samples = file.size // WIDTH  # a part of a sample at the end is dropped
            stop = WIDTH * (samples if self.high is None else min(samples, self.high))
            out += [ByteRange(file.path, at, min(at + self.size, stop)) for at in range(WIDTH * self.low, stop, self.size)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, _ = _opened(self.path)
        with system.open_input_file(partition.file) as f:
            for at in range(partition.start, partition.stop, BLOCK):
                values = np.frombuffer(f.read_at(min(BLOCK, partition.stop - at), at), "<f4")
                idx = np.arange(at // WIDTH, at // WIDTH + len(values), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([partition.file]).take(pa.array(np.zeros(len(values), np.int32))), pa.array(idx), pa.array(values)], names=["file", "idx", "value"])


class RawSamples(DataSource):
    """``raw_samples`` with options path, rate, start, duration (seconds) and range (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "raw_samples"

    def schema(self) -> str:
        return "file string, idx long, value float"

    def reader(self, schema) -> SampleReader:
        return SampleReader(self.options)


def read_samples(spark: SparkSession, path: str, rate: int, start: float = 0.0, duration: float | None = None, byte_range: int = RANGE) -> DataFrame:
    """Samples of raw files as (file, idx, value), within a window of seconds; idx counts from a file's beginning."""
    from tidemark.session import make_importable

    make_importable(spark)
    spark.dataSource.register(RawSamples)
    reader = spark.read.format("raw_samples").option("path", path).option("rate", str(rate)).option("start", str(start)).option("range", str(byte_range))
    return (reader if duration is None else reader.option("duration", str(duration))).load()
