"""Queries that write tables in the forms that sources have and read them again, and of the parts that go with them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import MICROS
from tidemark.operators import layout, store, track
from tidemark.plans import editing
from tidemark.queries.common import EVENTS, events, rounded, table
from tidemark.queries.media import _E, _seconds
from tidemark.session import shared_folder
from tidemark.sources import chat, documents, media

DAY = 86_400 * MICROS


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as chat messages and read back; some have no emotes."""
    e = _seconds(events(spark, sf_dir))
    emotes = F.when(F.col("seq") % 3 > 0, F.array(F.col("event_type"), F.lit("Kappa")))
    messages = e.select(F.col("t").alias("ts"), F.concat(F.lit("user "), "user_id").alias("user"), F.concat("event_type", F.lit(" \"said\" é\n"), "seq").alias("text"), emotes.alias("emotes"))
    place = _place(spark, "chat")
    chat.write_chat_json(messages, place)
    return chat.read_chat_json(spark, place).select(F.round("ts", 3).alias("ts"), "user", "text", F.array_join("emotes", ",").alias("emotes"))


def chat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as one document each, under the keys of several services, read by their common reader."""
    e = _seconds(events(spark, sf_dir))
    own = F.to_json(F.struct(F.col("t").alias("offset_seconds"), F.struct(F.col("event_type").alias("display_name")).alias("commenter"), F.struct(F.concat(F.lit("m"), "seq").alias("body")).alias("message")))
    other = F.to_json(F.struct(F.col("t").alias("ts"), F.lit("").alias("user"), F.col("event_type").alias("username"), F.concat(F.lit("m"), "seq").alias("text")))
    rows = e.select("user_id", F.struct("t", "seq", F.when(F.col("user_id") % 2 == 0, own).otherwise(other).alias("json")).alias("x"))
    docs = rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["json"]), ",").alias("list"))
    whole = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('{"comments":['), "list", F.lit("]}"))).otherwise(F.concat(F.lit("["), "list", F.lit("]")))
    # A file for each user would be many small ones; what the reader does to a file's text is done to each document.
    items = chat.document_items(docs.select("user_id", whole.alias("value")))
    return chat.parse_messages(items).select("user_id", F.col("seq").cast("long").alias("seq"), F.round("ts", 3).alias("ts"), "user", "text")


def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a chat protocol, some of them no messages."""
    e = _seconds(events(spark, sf_dir))
    said = F.concat(F.lit(":u"), "user_id", F.lit("!u@host PRIVMSG #room :"), "event_type", F.lit(": "), "seq")
    line = F.when(F.col("seq") % 7 == 0, "PING :host").when(F.col("seq") % 5 == 0, F.concat(F.lit(":u"), "user_id", F.lit("!u@host JOIN #room"))).when(F.col("seq") % 3 == 0, F.concat(F.lit("@badge=1;id="), "seq", F.lit(" "), said)).otherwise(said)
    return chat.parse_lines(e.select("seq", (F.col("t") + 100).alias("received"), line.alias("value")), origin=F.lit(100.0)).select("seq", F.round("ts", 3).alias("ts"), "user", "text")


def _renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of an order's lines as revisions; the table has some numbers twice."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("candidate_id"), F.col("l_linenumber").cast("long").alias("revision")).agg(F.max("l_returnflag").alias("flag"))
    return lines.select("candidate_id", "revision", F.when(F.col("flag") == "R", "failed").otherwise("ok").alias("status"))


def newest_renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three revisions of each candidate."""
    return store.newest_revisions(_renders(spark, sf_dir), 3).select("candidate_id", "revision", "status", F.col("place").cast("long").alias("place"))


def caption_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles and anchors of parts, by names that are known or not and settings that are there or not."""
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    name = F.element_at(F.array(F.lit("karaoke_highlight"), F.lit("block_pop"), F.lit("minimal"), F.lit("old")), (size % 4 + 1).cast("int"))
    area = F.element_at(F.array(F.lit("auto"), F.lit("top"), F.lit("middle"), F.lit("bottom"), F.lit("left")), (key % 5 + 1).cast("int"))
    style = layout.resolve_style(name, F.when(key % 3 == 0, "Inter").otherwise(""), F.when(key % 7 == 0, size).otherwise(F.lit(0)))
    return p.select("p_partkey", style.alias("s"), layout.resolve_anchor(area, size % 2 == 0).alias("a")).select("p_partkey", "s.name", "s.font", "s.size", "s.bold", "s.capitals", "s.karaoke", "s.outline", "s.shadow", "s.pop", "a.anchor", "a.alignment")


def reused_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: those planned before from the same source keep their bounds."""
    o = table(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").alias("candidate_id"), F.col("o_orderpriority").alias("source_path"))
    before = o.filter(F.col("o_orderkey") % 3 > 0).select(F.col("o_orderkey").alias("candidate_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("moved").alias("source_path"), F.col("o_totalprice").alias("start"), (F.col("o_totalprice") + 30).alias("end"))
    return editing.reuse_bounds(jobs, before).select("candidate_id", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"))


def checked_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides of edits: which names are not allowed."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.element_at(F.array(F.lit("auto"), F.lit("irl"), F.lit("gaming"), F.lit("sideways")), (F.col("p_size") % 4 + 1).cast("int"))).alias("strategy"), F.when(F.col("p_partkey") % 2 == 0, "minimal").when(F.col("p_partkey") % 5 == 0, "neon").alias("style"))
    _, bad = store.validate(p, {"strategy": ("auto", "irl", "gaming", "conversation", "fit_blur"), "style": tuple(layout.CAPTIONS)})
    return bad.select("p_partkey", "rejected_because")


def exported_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviews, exported with the fixed columns and read back."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("candidate_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected").alias("decision"), F.concat(F.lit('a, "b" '), "o_orderpriority").alias("notes"), F.col("o_totalprice").alias("score"), F.lit("left out").alias("signals"))
    place = _place(spark, "reviews")
    documents.export_csv(o, place)
    back = spark.read.option("header", True).option("escape", "\\").csv(place)
    return back.select(F.col("review_id").cast("long"), F.col("candidate_id").cast("long"), "decision", "notes", F.round(F.col("score").cast("double"), 2).alias("score"), F.lit(len(back.columns)).alias("columns"))


def exported_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviews, exported as JSON and read back."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("notes"), F.col("o_totalprice").alias("score"))
    place = _place(spark, "reviews")
    documents.export_json(o, place)
    return spark.read.schema(o.schema).json(place).select("review_id", "notes", F.round("score", 2).alias("score"))


def loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logs of a loudness pass: the last block with an input level counts."""
    e = events(spark, sf_dir)
    block = lambda name, v: F.concat(F.lit("[x] {\n \""), F.lit(name), F.lit("\" : \""), v.cast("string"), F.lit("\",\n \"input_tp\" : \"-1.5\", \"type\" : \"dynamic\"\n}\n"))
    log = F.concat(F.lit("size= 1 {not json\n"), block("input_i", -F.col("seq") / 4), F.when(F.col("seq") % 3 == 0, block("input_i", -F.col("seq") / 2)).otherwise(block("other", F.col("seq"))))
    got = media.loudness(e.select("seq", F.when(F.col("seq") % 5 > 0, log).otherwise("nothing").alias("text")))
    return got.select("seq", F.round(F.col("loudness")["input_i"], 4).alias("level"), F.round(F.col("loudness")["input_tp"], 4).alias("peak"))


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's days as pictures of four rows of six hours, each the sum of whole values."""
    e = events(spark, sf_dir).withColumns({"frame": F.floor(F.col("us") / DAY), "hour": F.floor(F.col("us") % DAY / (3600 * MICROS))})
    cells = e.groupBy(F.col("user_id").alias("clip_id"), "frame", "hour").agg(F.sum(F.floor("value")).alias("v"))
    packed = cells.groupBy("clip_id", "frame").agg(F.map_from_entries(F.collect_list(F.struct("hour", "v"))).alias("m"))
    row = lambda r: F.array(*(F.coalesce(F.try_element_at("m", F.lit(6 * r + c).cast("long")), F.lit(0).cast("long")) for c in range(6)))
    return packed.select("clip_id", "frame", F.array(*(row(r) for r in range(4))).alias("pixels"))


def motion_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a user's days differ from the one before, by hour of the quarter and by quarter of the day."""
    return track.motion_profiles(_pictures(spark, sf_dir)).select("clip_id", "frame", "axis", F.col("place").cast("long").alias("place"), "energy")


def motion_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the difference lies, smoothed over the days."""
    got = track.motion_track(track.motion_profiles(_pictures(spark, sf_dir)), ["clip_id"], 1.0)
    return got.select("clip_id", "seq", rounded(F.col("x"), 6).alias("x"), rounded(F.col("y"), 6).alias("y"))


def live_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive as a stream and are counted per type and hour as the watermark passes."""
    from tidemark.streaming import live

    source = table(spark, sf_dir, "events")
    place = _place(spark, "activity")
    source.limit(1).select(F.lit("last").alias("event_type"), F.lit("2100-01-01").cast("timestamp").alias("ts")).write.parquet(f"{place}/last")
    arrived = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    last = spark.readStream.schema("event_type string, ts timestamp").parquet(f"{place}/last")
    found = live.activity(arrived.union(last), "1 hour", "10 minutes", ["event_type"])
    live.collect_arrived(found, f"{place}/table", f"{place}/offsets")
    out = spark.read.schema(found.schema).parquet(f"{place}/table")
    return out.select("event_type", F.unix_micros("start").alias("start_us"), "n")


_CELLS = f"""{EVENTS}, d AS (SELECT DISTINCT user_id AS clip_id, us // {DAY} AS frame FROM e),
c AS (SELECT user_id AS clip_id, us // {DAY} AS frame, us % {DAY} // 3600000000 AS hour, sum(floor(value)) AS v FROM e GROUP BY ALL),
p AS (SELECT d.clip_id, d.frame, h.hour, coalesce(v, 0) AS v FROM d, range(0, 24) h(hour) LEFT JOIN c ON c.clip_id = d.clip_id AND c.frame = d.frame AND c.hour = h.hour),
g AS (SELECT clip_id, frame, hour, abs(v - lag(v) OVER (PARTITION BY clip_id, hour ORDER BY frame)) AS change FROM p),
m AS (SELECT clip_id, frame, 'x' AS axis, hour % 6 AS place, sum(change)::DOUBLE AS energy FROM g WHERE change IS NOT NULL GROUP BY ALL
      UNION ALL SELECT clip_id, frame, 'y', hour // 6, sum(change)::DOUBLE FROM g WHERE change IS NOT NULL GROUP BY ALL)"""
_TRACK = f"""WITH RECURSIVE {_CELLS},
k AS (SELECT clip_id, frame, axis, CASE WHEN sum(energy) <= 1e-9 THEN 0.5::DOUBLE ELSE 0.65::DOUBLE * (sum(energy * (place + 0.5::DOUBLE)) / count(*) / sum(energy)) + 0.35::DOUBLE * 0.5::DOUBLE END AS center FROM m GROUP BY ALL),
r AS (SELECT clip_id, frame, max(center) FILTER (WHERE axis = 'x') AS x, max(center) FILTER (WHERE axis = 'y') AS y, row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS rn FROM k GROUP BY clip_id, frame),
t AS (SELECT clip_id, frame, rn, x, y FROM r WHERE rn = 1
      UNION ALL SELECT r.clip_id, r.frame, r.rn, t.x + 0.12::DOUBLE * (r.x - t.x), t.y + 0.12::DOUBLE * (r.y - t.y) FROM t JOIN r ON r.clip_id = t.clip_id AND r.rn = t.rn + 1)
SELECT clip_id, frame AS seq, round(x, 6) AS x, round(y, 6) AS y FROM t"""

QUERIES = {f.__name__: f for f in (chat_round_trip, chat_documents, chat_lines, newest_renders, caption_styles, reused_bounds, checked_overrides, exported_reviews, exported_json, loudness, motion_profiles, motion_tracks, live_activity)}
ORACLE_SQL = {
    "chat_round_trip": f"""WITH {_E} SELECT round(t, 3) AS ts, 'user ' || user_id AS "user", event_type || ' "said" é' || chr(10) || seq AS text, CASE WHEN seq % 3 > 0 THEN event_type || ',Kappa' END AS emotes FROM s""",
    "chat_documents": f"""WITH {_E} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, seq) - 1 AS seq, round(t, 3) AS ts, event_type AS "user", 'm' || s.seq AS text FROM s""",
    "chat_lines": f"""WITH {_E} SELECT seq, round(t, 3) AS ts, 'u' || user_id AS "user", event_type || ': ' || seq AS text FROM s WHERE seq % 7 <> 0 AND seq % 5 <> 0""",
    "newest_renders": """WITH r AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL)
SELECT l_orderkey AS candidate_id, l_linenumber::BIGINT AS revision, CASE WHEN flag = 'R' THEN 'failed' ELSE 'ok' END AS status, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS place FROM r QUALIFY place <= 3""",
    "caption_styles": """WITH n AS (SELECT *, CASE p_size % 4 WHEN 1 THEN 'block_pop' WHEN 2 THEN 'minimal' ELSE 'karaoke_highlight' END AS name FROM part),
a AS (SELECT *, CASE p_partkey % 5 WHEN 1 THEN 'top' WHEN 2 THEN 'middle' WHEN 3 THEN 'bottom' ELSE CASE WHEN p_size % 2 = 0 THEN 'top' ELSE 'bottom' END END AS anchor FROM n)
SELECT p_partkey, name, CASE WHEN p_partkey % 3 = 0 THEN 'Inter' ELSE 'Arial' END AS font, (CASE WHEN p_partkey % 7 = 0 AND p_size <> 0 THEN p_size ELSE CASE name WHEN 'block_pop' THEN 60 WHEN 'minimal' THEN 44 ELSE 54 END END)::BIGINT AS size,
 (name <> 'minimal')::INTEGER AS bold, name <> 'minimal' AS capitals, name = 'karaoke_highlight' AS karaoke, CASE name WHEN 'block_pop' THEN 5 WHEN 'minimal' THEN 3 ELSE 4 END AS outline,
 CASE name WHEN 'block_pop' THEN 3 WHEN 'minimal' THEN 1 ELSE 2 END AS shadow, CASE name WHEN 'block_pop' THEN 108 ELSE 0 END AS pop, anchor, CASE anchor WHEN 'top' THEN 8 WHEN 'middle' THEN 5 ELSE 2 END AS alignment FROM a""",
    "reused_bounds": """SELECT o_orderkey AS candidate_id, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 2 = 0 THEN round(o_totalprice, 2) END AS start, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 2 = 0 THEN round(o_totalprice + 30, 2) END AS "end" FROM orders""",
    "checked_overrides": """SELECT p_partkey, CASE WHEN p_size % 3 > 0 AND p_size % 4 = 3 THEN 'strategy may not be sideways' ELSE 'style may not be neon' END AS rejected_because FROM part WHERE p_size % 3 > 0 AND p_size % 4 = 3 OR p_partkey % 2 = 1 AND p_partkey % 5 = 0""",
    "exported_reviews": """SELECT o_orderkey AS review_id, o_custkey AS candidate_id, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'rejected' END AS decision, 'a, "b" ' || o_orderpriority AS notes, round(o_totalprice, 2) AS score, 17::INTEGER AS columns FROM orders""",
    "exported_json": "SELECT o_orderkey AS review_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS notes, round(o_totalprice, 2) AS score FROM orders",
    "loudness": f"""WITH {EVENTS} SELECT seq, CASE WHEN seq % 5 > 0 THEN round(CASE WHEN seq % 3 = 0 THEN -seq / 2 ELSE -seq / 4 END, 4) END AS level, CASE WHEN seq % 5 > 0 THEN -1.5::DOUBLE END AS peak FROM e""",
    "motion_profiles": f"WITH {_CELLS} SELECT clip_id, frame, axis, place, energy FROM m",
    "motion_tracks": _TRACK,
    "live_activity": f"WITH {EVENTS} SELECT event_type, us // 3600000000 * 3600000000 AS start_us, count(*) AS n FROM e GROUP BY ALL",
}
