"""Samples, tool logs, files on disk and their retention."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_pcm(spark: SparkSession, path: str, rate: int, start: float = 0.0, duration: float | None = None) -> DataFrame:
    """Mono float32 samples of raw files as (file, idx, value), within a window of seconds."""
    low = int(start * rate)
    high = None if duration is None else low + int(duration * rate)

    def run(batches):
        for frame in batches:
            for path_, content in zip(frame["path"], frame["content"], strict=True):
                samples = np.frombuffer(content[: len(content) // 4 * 4], "<f4")[low:high]
                for at in range(0, len(samples), 1 << 16):
                    part = samples[at : at + (1 << 16)]
                    yield pd.DataFrame({"file": path_, "idx": np.arange(at, at + len(part)), "value": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, idx long, value float")


def parse_silences(lines: DataFrame, keys: list[str], order: str = "seq", line: str = "value", end_hint: str | None = None) -> DataFrame:
    """Silences of a detector's log: each start with the next end, a last open one closed at ``end_hint`` or dropped."""
    number = lambda name: F.regexp_extract(F.col(line), name + r":\s*(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    marks = lines.withColumns({"at_start": number("silence_start"), "at_end": number("silence_end")}).filter("at_start is not null or at_end is not null")
    w = Window.partitionBy(*keys).orderBy(order)
    hint = F.lit(None).cast("double") if end_hint is None else F.col(end_hint).cast("double")
    paired = marks.withColumn("next_end", F.lead("at_end").over(w)).withColumn("last", F.lead(order).over(w).isNull()).filter("at_start is not null")
    out = paired.select(*keys, F.greatest("at_start", F.lit(0.0)).alias("start"), F.coalesce("next_end", F.when(F.col("last"), hint)).alias("end"))
    return out.filter("end > start")


def loudness(logs: DataFrame, text: str = "text") -> DataFrame:
    """Numbers of the last JSON blocks in a log that hold ``input_i``, as a map ``loudness``; null without one."""

    def blocks(log: str):
        decoder, at = json.JSONDecoder(), 0
        while (at := log.find("{", at)) >= 0:
            try:
                found, end = decoder.raw_decode(log, at)
                yield found
                at = end
            except ValueError:
                at += 1

    @F.pandas_udf("map<string,double>")
    def parse(logs: pd.Series) -> pd.Series:
        out = []
        for log in logs:
            numbers: dict[str, float] = {}
            for found in blocks(log or ""):
                if "input_i" in found:
                    for k, v in found.items():
                        try:
                            numbers[k] = float(v)
                        except (TypeError, ValueError):
                            continue
            out.append(numbers or None)
        return pd.Series(out, dtype="object")

    return logs.withColumn("loudness", parse(F.col(text)))


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, size, modified) of files; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def within_budget(listed: DataFrame, budget: int) -> DataFrame:
    """One row: total size, and whether it is below the budget."""
    return listed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total")).withColumn("fits", F.col("total") < budget)


def prune_plan(listed: DataFrame, keys: list[str], budget: int, protected: str | None = None) -> DataFrame:
    """Files to delete, oldest first, until each key's total is within the budget; 0 and less delete none, protected files stay."""
    if budget <= 0:
        return listed.limit(0)
    by = Window.partitionBy(*keys)
    free = F.lit(True) if protected is None else ~F.col(protected)
    older = F.sum(F.when(free, F.col("size")).otherwise(0)).over(by.orderBy("modified", "path").rowsBetween(Window.unboundedPreceding, -1))
    marked = listed.withColumn("excess", F.sum("size").over(by) - budget).withColumn("before", F.coalesce(older, F.lit(0)))
    return marked.filter(free & (F.col("before") < F.col("excess"))).drop("excess", "before")


def retained(segments: DataFrame, keys: list[str], retention: int, at: str = "us") -> DataFrame:
    """Segments not older than ``retention`` before the newest of their key; those without a time are dropped."""
    last = segments.groupBy(*keys).agg(F.max(at).alias("newest"))
    return segments.join(last, keys).filter(F.col(at) >= F.col("newest") - retention).drop("newest")
