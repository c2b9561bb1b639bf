"""Queries of the interval operators: each event is a span of ``value`` hundred seconds of its user's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DeadAir
from tidemark.functions.times import MICROS
from tidemark.operators import deadair, fusion, spans
from tidemark.queries.common import EVENTS, events, table
from tidemark.sources import media

DAY = 86_400 * MICROS
KEY = ["user_id"]


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("user_id", F.col("us").alias("start"), (F.col("us") + F.floor(F.col("value") * 100) * MICROS).alias("end"))


def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merge(_spans(spark, sf_dir), KEY, 1800 * MICROS)


def _month(df: DataFrame) -> DataFrame:
    start = 1704067200 * MICROS
    return df.select("user_id").distinct().select("user_id", F.lit(start).alias("low"), F.lit(start + 30 * DAY).alias("high"))


def span_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = spans.merge(_spans(spark, sf_dir), KEY)
    return spans.gaps(merged, KEY, _month(merged))


def span_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged spans without the first six hours of each day."""
    merged = spans.merge(_spans(spark, sf_dir), KEY)
    days = merged.select("user_id", F.explode(F.sequence(F.floor(F.col("start") / DAY), F.floor(F.col("end") / DAY))).alias("day")).distinct()
    blocks = days.select("user_id", (F.col("day") * DAY).alias("start"), (F.col("day") * DAY + 6 * 3600 * MICROS).alias("end"))
    return spans.subtract(merged, blocks, KEY, DAY)


def span_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shrink(spans.merge(_spans(spark, sf_dir), KEY), KEY, 900 * MICROS)


def covered_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.covered(_spans(spark, sf_dir), KEY)


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user less than an hour after the last span as one utterance of event types."""
    e = events(spark, sf_dir)
    words = e.select("user_id", F.col("us").alias("start"), (F.col("us") + F.floor(F.col("value") * 100) * MICROS).alias("end"), F.col("event_type").alias("text"))
    return spans.utterances(words, KEY, 3600 * MICROS)


def low_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of low values of a type, two and more in a row by time."""
    e = events(spark, sf_dir)
    return spans.low_runs(e, ["event_type"], 30.0, 600 * MICROS, 60 * MICROS)


def _clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A clip is a user's day in tenths of seconds; silence is what the user's spans leave of it."""
    e = _spans(spark, sf_dir).withColumn("day", F.floor(F.col("start") / DAY)).withColumn("clip_id", F.concat_ws("-", "user_id", "day"))
    second = lambda c: (F.col(c) - F.col("day") * DAY) / (100.0 * MICROS)
    said = e.select("clip_id", second("start").alias("start"), F.least(second("end"), F.lit(864.0)).alias("end"))
    clips = e.select("clip_id").distinct().withColumn("duration", F.lit(864.0))
    quiet = spans.gaps(spans.merge(said, ["clip_id"]), ["clip_id"], clips.select("clip_id", F.lit(0.0).alias("low"), F.col("duration").alias("high")))
    return clips, quiet


def deadair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips, quiet = _clips(spark, sf_dir)
    got = deadair.plan(clips, quiet, DeadAir())["summary"]
    return got.select("clip_id", "applied", F.round("removed_seconds", 3).alias("removed_seconds"), "n_gaps", "capped", "reason")


def deadair_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips, quiet = _clips(spark, sf_dir)
    cfg = DeadAir(mode="speed")
    got = deadair.render_segments(deadair.plan(clips, quiet, cfg), cfg)
    return got.select("clip_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "speed")


def containing_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged span that holds each user's noons."""
    merged = spans.merge(_spans(spark, sf_dir), KEY)
    noon = events(spark, sf_dir).select("user_id", (F.floor(F.col("us") / DAY) * DAY + DAY // 2).alias("us")).distinct()
    return fusion.containing(noon, merged, KEY, DAY).select("user_id", "us", F.col("span.start").alias("start"), F.col("span.end").alias("end"))


def prune_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as files of a part: the oldest go until each part is within 100 units; returned items are protected."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), "l_linenumber").alias("path"), F.col("l_quantity").cast("long").alias("size"), F.col("l_shipdate").alias("modified"), (F.col("l_returnflag") == "R").alias("kept"))
    return media.prune_plan(li, ["l_partkey"], 100, "kept").select("l_partkey", "path", "size")


def retained_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.retained(events(spark, sf_dir).select("user_id", "seq", "us"), KEY, 2 * DAY)


_S = f"{EVENTS}, s AS (SELECT user_id, us AS a, us + CAST(floor(value * 100) AS BIGINT) * 1000000 AS b, event_type FROM e WHERE floor(value * 100) > 0)"


def _merge_sql(name: str, source: str, key: str, gap: int, op: str = ">") -> str:
    return f"""{name}_f AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY {key} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) {op} {gap} IS NOT FALSE THEN 1 ELSE 0 END AS fresh FROM {source}),
{name}_g AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM {name}_f),
{name} AS (SELECT {key}, min(a) AS a, max(b) AS b, count(*) AS n FROM {name}_g GROUP BY {key}, grp)"""


_M = f"{_S}, {_merge_sql('m', 's', 'user_id', 0)}"
_MONTH = 1704067200000000
_GAPS = f"""SELECT user_id, greatest(coalesce(lag(b) OVER (PARTITION BY user_id ORDER BY a), {_MONTH}), {_MONTH}) AS start, least(a, {_MONTH + 30 * DAY}) AS "end" FROM m
UNION ALL SELECT user_id, max(b), {_MONTH + 30 * DAY} FROM m WHERE a < {_MONTH + 30 * DAY} GROUP BY user_id"""
_CLIP = f"""{EVENTS}, d AS (SELECT user_id || '-' || (us // {DAY}) AS clip_id, (us - us // {DAY} * {DAY}) / 100000000.0::DOUBLE AS a,
 least((us + CAST(floor(value * 100) AS BIGINT) * 1000000 - us // {DAY} * {DAY}) / 100000000.0::DOUBLE, 864.0::DOUBLE) AS b FROM e),
c AS (SELECT DISTINCT clip_id FROM d), s AS (SELECT * FROM d WHERE b > a), {_merge_sql('m', 's', 'clip_id', 0)},
q AS (SELECT * FROM (SELECT clip_id, coalesce(lag(b) OVER (PARTITION BY clip_id ORDER BY a), 0.0) AS a, a AS b FROM m UNION ALL SELECT c.clip_id, coalesce(x.b, 0.0), 864.0 FROM c LEFT JOIN (SELECT clip_id, max(b) AS b FROM m GROUP BY 1) x USING (clip_id)) WHERE b > a),
{_merge_sql('h', 'q', 'clip_id', '0.2::DOUBLE')},
k AS (SELECT clip_id, a + 0.2 AS a, b - 0.2 AS b FROM h WHERE b - a > 0.4), {_merge_sql('l0', 'k', 'clip_id', 0)},
l AS (SELECT * FROM l0 WHERE b - a >= 0.8),
r AS (SELECT *, sum(b - a) OVER (PARTITION BY clip_id ORDER BY round(b - a, 3), a DESC ROWS UNBOUNDED PRECEDING) AS run FROM l),
cut AS (SELECT clip_id, a, b FROM r WHERE run <= 864.0 * 0.4 + 1e-9)"""
_PLAN = f"""WITH {_CLIP},
z AS (SELECT clip_id, coalesce(lag(b) OVER (PARTITION BY clip_id ORDER BY a), 0.0) AS a, a AS b FROM cut UNION ALL SELECT clip_id, max(b), 864.0 FROM cut GROUP BY clip_id),
kept AS (SELECT clip_id, sum(b - a) AS kept, count(*) AS parts FROM z WHERE b - a >= 0.5 GROUP BY clip_id),
n AS (SELECT c.clip_id, (SELECT count(*) FROM h WHERE h.clip_id = c.clip_id) AS heard, (SELECT count(*) FROM l WHERE l.clip_id = c.clip_id) AS long, (SELECT count(*) FROM cut WHERE cut.clip_id = c.clip_id) AS gaps, kept, coalesce(parts, 0) AS parts FROM c LEFT JOIN kept USING (clip_id))
SELECT clip_id, gaps > 0 AND parts > 0 AS applied, round(CASE WHEN gaps > 0 AND parts > 0 THEN greatest(0.0, 864.0 - kept) ELSE 0.0 END, 3) AS removed_seconds, gaps AS n_gaps, gaps < long AS capped,
 CASE WHEN heard = 0 THEN 'no silence detected: nothing worth cutting' WHEN long = 0 THEN 'every silent gap was too short to be worth cutting' WHEN gaps = 0 THEN 'the cap left nothing cuttable' WHEN parts = 0 THEN 'cutting would have removed the whole clip' END AS reason FROM n"""
_SPEED = f"""WITH {_CLIP},
z AS (SELECT clip_id, coalesce(lag(b) OVER (PARTITION BY clip_id ORDER BY a), 0.0) AS a, a AS b FROM cut UNION ALL SELECT c.clip_id, coalesce(x.b, 0.0), 864.0 FROM c LEFT JOIN (SELECT clip_id, max(b) AS b FROM cut GROUP BY 1) x USING (clip_id))
SELECT clip_id, round(a, 3) AS start, round(b, 3) AS "end", 1.0::DOUBLE AS speed FROM z WHERE b > a UNION ALL SELECT clip_id, round(a, 3), round(b, 3), 1.5::DOUBLE FROM cut"""

QUERIES = {f.__name__: f for f in (merged_spans, span_gaps, span_minus, span_shrink, covered_seconds, utterances, low_runs, deadair_plan, deadair_speed, containing_span, prune_plan, retained_segments)}
ORACLE_SQL = {
    "merged_spans": f'WITH {_S}, {_merge_sql("m", "s", "user_id", 1800 * MICROS)} SELECT user_id, a AS start, b AS "end" FROM m',
    "span_gaps": f'WITH {_M} SELECT * FROM ({_GAPS}) WHERE "end" > start',
    "span_minus": f"""WITH {_M}, p AS (SELECT user_id, a, b, unnest(range(a // {DAY}, b // {DAY} + 1)) AS day FROM m),
r AS (SELECT user_id, greatest(a, day * {DAY} + 6 * 3600000000) AS start, least(b, (day + 1) * {DAY}) AS "end" FROM p),
j AS (SELECT * FROM r WHERE "end" > start) SELECT user_id, start, "end" FROM j""",
    "span_shrink": f'WITH {_M} SELECT user_id, a + 900000000 AS start, b - 900000000 AS "end" FROM m WHERE b - a > 1800000000',
    "covered_seconds": f"WITH {_M} SELECT user_id, CAST(sum(b - a) AS BIGINT) AS length FROM m GROUP BY user_id",
    "utterances": f"""WITH {_S}, {_merge_sql("m", "s", "user_id", 3600 * MICROS, ">=")} SELECT user_id, min(a) AS start, max(b) AS "end", string_agg(trim(event_type), ' ' ORDER BY a, b, event_type) AS text, count(*) AS n_words FROM m_g GROUP BY user_id, grp""",
    "low_runs": f"""WITH {EVENTS}, f AS (SELECT *, CASE WHEN (value < 30.0) IS DISTINCT FROM lag(value < 30.0) OVER (PARTITION BY event_type ORDER BY us) THEN 1 ELSE 0 END AS fresh FROM e),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY us ROWS UNBOUNDED PRECEDING) AS grp FROM f)
SELECT event_type, min(us) AS start, max(us) + 60000000 AS "end" FROM g WHERE value < 30.0 GROUP BY event_type, grp HAVING max(us) + 60000000 - min(us) >= 600000000""",
    "deadair_plan": _PLAN,
    "deadair_speed": _SPEED,
    "containing_span": f"""WITH {_M}, n AS (SELECT DISTINCT user_id, us // {DAY} * {DAY} + {DAY // 2} AS noon FROM e)
SELECT n.user_id, noon AS us, min(a) AS start, min(b) AS "end" FROM n JOIN m ON m.user_id = n.user_id AND noon BETWEEN a AND b GROUP BY ALL""",
    "prune_plan": """WITH f AS (SELECT l_partkey, lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || l_linenumber AS path, CAST(l_quantity AS BIGINT) AS size, l_shipdate AS modified, l_returnflag = 'R' AS kept FROM lineitem),
w AS (SELECT *, sum(size) OVER (PARTITION BY l_partkey) - 100 AS excess, coalesce(sum(CASE WHEN kept THEN 0 ELSE size END) OVER (PARTITION BY l_partkey ORDER BY modified, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS older FROM f)
SELECT l_partkey, path, size FROM w WHERE NOT kept AND older < excess""",
    "retained_segments": f"WITH {EVENTS} SELECT user_id, seq, us FROM e QUALIFY us >= max(us) OVER (PARTITION BY user_id) - {2 * DAY}",
}
