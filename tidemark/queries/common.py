"""The test tables as timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import timestamp_micros
from tidemark.session import make_importable

#: Events as SQL has them.
EVENTS = "e AS (SELECT event_id AS seq, epoch_us(ts) AS us, user_id, event_type, value FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, digits: int) -> Column:
    """Rounded as the SQL rounds doubles: the product with a power of ten to the nearest whole number, halves away from zero.

    Spark's round goes by the shortest decimal form instead, which is on the other side of a half for some values.
    """
    return F.round(c * 10.0**digits) / 10.0**digits


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, us, user_id, event_type, value; all of one stream (stream_id 0)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), timestamp_micros(F.col("ts")).alias("us"), "user_id", "event_type", "value", F.lit(0).cast("long").alias("stream_id"))
