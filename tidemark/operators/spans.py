"""Interval algebra on rows (keys, start, end): merging, gaps, differences, erosion, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequences import islands


def merge(spans: DataFrame, keys: Sequence[str], close_gap=0, inclusive: bool = True, clip: bool = True, extra: Sequence[Column] = ()) -> DataFrame:
    """Union of spans; spans at most ``close_gap`` apart (less than it, if not ``inclusive``) become one.

    Starts below zero are clipped and empty spans dropped.  ``extra`` are
    aggregates of the merged rows.
    """
    start = F.greatest(F.col("start"), F.lit(0)) if clip else F.col("start")
    real = spans.withColumn("start", start.cast(spans.schema["start"].dataType)).filter(F.col("end") > F.col("start"))
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    distance = F.col("start") - F.max("end").over(before)
    runs = islands(real, keys, ["start", "end"], distance > close_gap if inclusive else distance >= close_gap)
    return runs.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *extra).drop("island")


def gaps(merged: DataFrame, keys: Sequence[str], ranges: DataFrame) -> DataFrame:
    """What merged spans leave of each key's range (columns ``low``, ``high``), head and tail included."""
    inside = merged.join(ranges, list(keys)).filter((F.col("end") > F.col("low")) & (F.col("start") < F.col("high")))
    w = Window.partitionBy(*keys).orderBy("start")
    cut = inside.select(*keys, F.coalesce(F.lag("end").over(w), F.col("low")).alias("from"), F.col("start").alias("to"), "low", "high")
    tails = ranges.join(inside.groupBy(*keys).agg(F.max("end").alias("last")), list(keys), "left").select(*keys, F.coalesce("last", "low").alias("start"), F.col("high").alias("end"))
    heads = cut.select(*keys, F.greatest("from", "low").alias("start"), F.least("to", "high").alias("end"))
    return heads.unionByName(tails).filter(F.col("end") > F.col("start"))


def subtract(spans: DataFrame, blocks: DataFrame, keys: Sequence[str], size) -> DataFrame:
    """Spans without what ``blocks`` cover.  Both are bucketed by ``size`` so the join is on equal keys."""
    spread = lambda df, a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    numbered = spans.select(*keys, "start", "end").distinct()
    left = numbered.withColumn("bucket", spread(numbered, "start", "end"))
    right = blocks.select(*keys, F.col("start").alias("cut_from"), F.col("end").alias("cut_to"))
    right = right.withColumn("bucket", spread(right, "cut_from", "cut_to"))
    hits = left.join(right, [*keys, "bucket"]).filter((F.col("cut_from") < F.col("end")) & (F.col("cut_to") > F.col("start"))).select(*keys, "start", "end", "cut_from", "cut_to").distinct()
    id_keys = [*keys, "span_start", "span_end"]
    hits = hits.select(*keys, F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.greatest("cut_from", "start").alias("start"), F.least("cut_to", "end").alias("end"))
    touched = hits.select(*id_keys).distinct()
    rest = gaps(merge(hits, id_keys, clip=False), id_keys, touched.select(*id_keys, F.col("span_start").alias("low"), F.col("span_end").alias("high")))
    untouched = numbered.join(touched.select(*keys, F.col("span_start").alias("start"), F.col("span_end").alias("end")), [*keys, "start", "end"], "left_anti")
    return untouched.unionByName(rest.select(*keys, "start", "end"))


def shrink(spans: DataFrame, keys: Sequence[str], by) -> DataFrame:
    """Spans eroded at both ends, then merged again."""
    return merge(spans.select(*keys, (F.col("start") + by).alias("start"), (F.col("end") - by).alias("end")), keys)


def total(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summed length of spans per key."""
    return spans.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("length"))


def covered(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Length that spans cover, overlaps once."""
    return total(merge(spans, keys), keys)


def low_runs(series: DataFrame, keys: Sequence[str], below: float, least, frame, at: str = "us", value: str = "value") -> DataFrame:
    """Runs of values below a level that last ``least`` or longer; each value stands for ``frame`` from its time on."""
    w = Window.partitionBy(*keys).orderBy(at)
    quiet = F.col(value) < below
    runs = islands(series.withColumn("quiet", quiet), keys, [at], F.lag("quiet").over(w) != F.col("quiet"))
    found = runs.filter("quiet").groupBy(*keys, "island").agg(F.min(at).alias("start"), (F.max(at) + frame).alias("end")).drop("island")
    return found.filter(F.col("end") - F.col("start") >= least)


def utterances(words: DataFrame, keys: Sequence[str], gap) -> DataFrame:
    """Words less than ``gap`` apart as one utterance, texts joined in order."""
    real = words.filter(F.col("end") > F.col("start"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", F.trim("text").alias("text")))), lambda w: w["text"]), " ").alias("text")
    return merge(real, keys, gap, inclusive=False, clip=False, extra=[text, F.count("*").alias("n_words")])
