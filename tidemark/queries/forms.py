"""Queries of text forms, logs, documents and small plans, over the columns that resemble their inputs most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import alignment, messages, metadata, store
from tidemark.plans import editing
from tidemark.queries.common import EVENTS, events, table
from tidemark.queries.media import _E, _seconds
from tidemark.queries.words import _EDGE, _TIMED, _W, _turns, _words
from tidemark.sources import documents, media


def media_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and addresses of parts as recordings, channels, qualities and tools would have them."""
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    raw = F.element_at(F.array(F.lit("https://site.example/a"), F.concat(F.lit("videos/"), key), key.cast("string"), F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("_"))), (size % 5 + 1).cast("int"))
    quality = F.element_at(F.array(F.lit("best"), F.lit("Worst"), F.lit("audio"), F.concat(size * 20, F.lit("p60")), F.lit("source")), (key % 5 + 1).cast("int"))
    tool = F.element_at(F.array(F.lit("Streamlink"), F.lit("yt-dlp"), F.lit("other")), (size % 3 + 1).cast("int"))
    rate = F.element_at(F.array(F.concat(key, F.lit("/1001")), size.cast("string"), F.lit("n/a"), F.lit("1/0")), (key % 4 + 1).cast("int"))
    path = F.concat(F.lit("/rec/"), F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit("//"))
    return p.select(
        "p_partkey", tx.video_url(raw).alias("address"), tx.format_selector(quality).alias("format"), tx.downloader_name(tool).alias("tool"), tx.rational(rate).alias("rate"), tx.recording_name(path).alias("file"),
        tx.filter_path(F.concat(F.lit("C:\\it's\\"), "p_type")).alias("argument"), tx.hashtag(F.concat(F.lit("##"), "p_name")).alias("tag"), tx.hashtag_unicode(F.concat(F.lit("#Çé "), "p_brand")).alias("tag_unicode"), tx.strip_quotes(F.concat(F.lit('"'), "p_name", F.when(size % 2 == 0, '"').otherwise("'"))).alias("bare"),
    )


def answer_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON found within answers of a service; what does not parse is an empty object."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("Sure: "), F.when(F.col("event_id") % 3 == 0, F.replace("props", F.lit("}"), F.lit(""))).otherwise(F.col("props")), F.lit(" done"))
    return e.select("event_id", tx.json_object_text(text).alias("found"))


def answered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a conversation's last turn that its first turns hold as well."""
    turns = _turns(spark, sf_dir)
    last = turns.groupBy(F.col("conv_id").alias("clip_id")).agg(F.max_by("text", "turn").alias("answer"), F.max("turn").alias("top"))
    words = _words(spark, sf_dir).join(last.select(F.col("clip_id").alias("conv_id"), "top"), "conv_id").filter("turn < top").select(F.col("conv_id").alias("clip_id"), "text")
    return metadata.emphasis_from_answer(last.select("clip_id", "answer"), words).select("clip_id", F.array_join("words", " ").alias("words"))


def checked_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed titles and tags of conversations, held against what was said."""
    turns = _turns(spark, sf_dir).filter("turn <= 1")
    said = turns.groupBy(F.col("conv_id").alias("clip_id")).agg(F.max_by("text", -F.col("turn")).alias("transcript"), F.max_by("text", "turn").alias("chat_text"))
    clips = said.withColumn("login", F.lit("someone"))
    tags = F.array(F.lit("#someone"), F.lit("The"), F.lit("#nowhere"), F.lit("der"), F.lit("??"))
    asked = said.select("clip_id", F.when(F.col("clip_id") % 4 != 0, F.concat(F.lit('"'), F.substring("transcript", 1, 80), F.lit('"'))).alias("title"), F.lit("  about ").alias("description"), F.when(F.col("clip_id") % 3 != 0, tags).otherwise(F.array(F.lit("#nowhere"))).alias("hashtags"))
    return metadata.validate(asked, clips).select("clip_id", "title", "description", F.array_join("hashtags", ",").alias("hashtags"), "problem")


def attached_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as words, attached to each day they touch."""
    e = _seconds(events(spark, sf_dir))
    words = e.select(F.col("user_id").alias("clip_id"), F.col("t").alias("start"), (F.col("t") + F.col("value") * 60).alias("end"), F.col("event_type").alias("text"))
    days = e.select(F.col("user_id").alias("clip_id")).distinct().select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("segment_id")).withColumns({"start": F.col("segment_id") * 86400.0, "end": (F.col("segment_id") + 1) * 86400.0, "text": F.lit("day")})
    got = messages.attach_words(days, words, ["clip_id"], 86400.0)
    return got.select("clip_id", "segment_id", F.coalesce(F.size("words"), F.lit(0)).alias("n"), F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("words"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments: even conversations have words of their own, the others interpolated ones."""
    t = _turns(spark, sf_dir).select("conv_id", (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 10.0).alias("end"), "text")
    own = F.when(F.col("conv_id") % 2 == 0, F.array(F.struct((F.col("start") + 1).alias("start"), (F.col("start") + 2).alias("end"), F.col("text").alias("text"))))
    return messages.transcript_words(t.withColumn("words", own), ["conv_id"]).select("conv_id", "seq", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text")


def karaoke_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as one subtitle line each, with durations, and what such a line shows."""
    w = _words(spark, sf_dir).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "text"))).alias("words"))
    line = w.select("conv_id", "turn", tx.karaoke(F.col("words")).alias("line"))
    return line.select("conv_id", "turn", F.sha2("line", 256).alias("line_sha256"), tx.plain_line(F.col("line")).alias("shown"))


def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a silence detector's log: clicks begin a silence, views end one."""
    e = _seconds(events(spark, sf_dir))
    line = F.when(F.col("event_type") == "click", F.format_string("[d @ 1] silence_start: %.3f", F.col("t") - 5)).when(F.col("event_type") == "view", F.format_string("[d @ 1] silence_end: %.3f | silence_duration: 1", F.col("t"))).otherwise("frame= 1")
    logs = e.select("user_id", "seq", line.alias("value"), F.lit(30 * 86400.0).alias("whole"))
    return media.parse_silences(logs, ["user_id"], end_hint="whole").select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def offset_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as offsets, hours as scores: which of them are worth a warning."""
    e = _seconds(events(spark, sf_dir))
    offset, score = F.floor("value") / 8 - 5, F.floor(F.col("t") / 3600) % 24 / 64
    return e.select("seq", alignment.warning(offset, score, 2.0).alias("warning"))


def upscales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pictures: how much a plan enlarges them, and what to say about it."""
    p = table(spark, sf_dir, "part")
    width, height = (F.col("p_size") - 1) * 60, F.col("p_size") * 30
    factor = editing.plan_upscale(width, height, F.when(F.col("p_partkey") % 2 == 0, "fit_blur").otherwise("irl"), 1.25)
    return p.select("p_partkey", F.round(factor, 6).alias("factor"), F.array_join(editing.quality_warnings(width, height, factor), ",").alias("warnings"))


def media_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of plans on the clock of media that began later or earlier."""
    e = _seconds(events(spark, sf_dir))
    plans = e.select("seq", F.col("t").alias("start"), (F.col("t") + F.col("value")).alias("end"), F.when(F.col("seq") % 3 > 0, (F.col("seq") % 7 - 3) * 100_000.0).alias("source_offset"))
    return editing.source_range(plans).select("seq", F.round("media_start", 6).alias("media_start"), F.round("media_end", 6).alias("media_end"))


def thumbnail_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation's turns the longest text's middle, within a minute."""
    t = _turns(spark, sf_dir)
    rows = t.select(F.col("conv_id").alias("clip_id"), (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + F.length("text") / 16).alias("end")).filter("clip_id % 5 > 0")
    clips = t.select(F.col("conv_id").alias("clip_id")).distinct().withColumn("duration", F.lit(60.0))
    return messages.thumbnail_time(rows, clips).select("clip_id", F.round("at", 6).alias("at"))


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each user's events."""
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped").when(F.col("event_type") == "signup", F.lit(None)).otherwise("done")
    return store.run_counters(events(spark, sf_dir).select("user_id", outcome.alias("outcome")), ["user_id"])


def changed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose size or brand differ from what was recorded for them."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    none = p.limit(0).select("p_partkey", F.lit("").alias("fingerprint"))
    before = p.withColumn("p_size", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    done = store.changed_inputs(before, none, ["p_partkey"], ["p_size", "p_brand"]).select("p_partkey", "fingerprint")
    return store.changed_inputs(p, done, ["p_partkey"], ["p_size", "p_brand"]).select("p_partkey", "fingerprint")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as documents and read again with a field they lack and one that is not readable."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus")).alias("status"))
    text = F.when(F.col("o_orderkey") % 9 == 0, F.lit("{broken")).otherwise(documents.to_documents(o, ["o_totalprice", "status"]))
    got = documents.from_documents(o.select("o_orderkey", text.alias("value")), "o_totalprice double, status string, speed double", {"o_totalprice": 0.0, "status": "auto", "speed": 1.5})
    return got.select("o_orderkey", F.col("o_totalprice").alias("price"), "status", "speed")


_CASE = lambda n, *choices: f"CASE {n} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(choices)) + " END"
_SHOWN = "regexp_replace(translate(replace(trim(text), chr(92), chr(92) || chr(92)), '{}', '()'), '[\\r\\n]+', ' ', 'g')"
_NAMES = f"""WITH r AS (SELECT *, {_CASE("p_size % 5", "'https://site.example/a'", "'videos/' || p_partkey", "p_partkey::VARCHAR", "''", "replace(p_name, ' ', '_')")} AS raw,
 {_CASE("p_partkey % 5", "'best'", "'worst'", "'audio'", "(p_size * 20) || 'p60'", "'source'")} AS q FROM part)
SELECT p_partkey, CASE WHEN raw = '' THEN NULL WHEN raw LIKE 'https://%' THEN raw WHEN regexp_full_match(raw, '[0-9]+') THEN 'https://www.twitch.tv/videos/' || raw ELSE 'https://www.twitch.tv/' || raw END AS address,
 CASE q WHEN 'worst' THEN 'worst' WHEN 'audio' THEN 'ba/b' WHEN 'best' THEN 'bv*+ba/b' WHEN 'source' THEN 'bv*+ba/b' ELSE 'bv*[height<=' || (p_size * 20) || ']+ba/b[height<=' || (p_size * 20) || ']' END AS format,
 {_CASE("p_size % 3", "'streamlink'", "'yt_dlp'", "NULL")} AS tool, {_CASE("p_partkey % 4", "round(p_partkey / 1001, 3)", "p_size::DOUBLE", "NULL", "NULL")} AS rate,
 regexp_replace(p_name, '[^\\pL\\pN_-]', '_', 'g') || '.ts' AS file, 'C' || chr(92) || ':/it' || chr(92) || '''s/' || p_type AS argument, regexp_replace(lower(p_name), '[^a-z0-9_]', '', 'g') AS tag,
 regexp_replace('çé' || lower(p_brand), '[^\\pL\\pN_]', '', 'g') AS tag_unicode, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '"' || p_name || '''' END AS bare FROM r"""

QUERIES = {f.__name__: f for f in (media_names, answer_objects, answered_words, checked_metadata, attached_words, transcripts, karaoke_lines, silences, offset_warnings, upscales, media_ranges, thumbnail_times, run_counters, changed_inputs, read_documents)}
ORACLE_SQL = {
    "media_names": _NAMES,
    "answer_objects": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{}' ELSE props END AS found FROM events",
    "answered_words": f"""WITH {_W}, l AS (SELECT conv_id AS clip_id, arg_max(text, turn) AS answer, max(turn) AS top FROM t GROUP BY 1),
f AS (SELECT DISTINCT conv_id AS clip_id, lower({_EDGE}) AS form FROM w JOIN l ON clip_id = conv_id WHERE turn < top),
a AS (SELECT clip_id, unnest(string_split_regex(answer, '[^0-9A-Za-z'']+')) AS text, generate_subscripts(string_split_regex(answer, '[^0-9A-Za-z'']+'), 1) AS pos FROM l),
d AS (SELECT clip_id, lower({_EDGE}) AS form, min(pos) AS pos FROM a GROUP BY ALL),
k AS (SELECT d.* FROM d JOIN f USING (clip_id, form) WHERE form <> '' QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY pos) <= 12)
SELECT l.clip_id, coalesce(string_agg(form, ' ' ORDER BY pos), '') AS words FROM l LEFT JOIN k USING (clip_id) GROUP BY l.clip_id""",
    "checked_metadata": f"""WITH t AS (SELECT conv_id AS clip_id, turn, text FROM conversations WHERE turn <= 1), s AS (SELECT clip_id, arg_min(text, turn) AS a, arg_max(text, turn) AS b FROM t GROUP BY 1),
w AS (SELECT *, regexp_extract_all(lower(concat_ws(' ', a, b, 'someone')), '([a-z0-9_]+)', 1) AS words FROM s),
g AS (SELECT *, CASE WHEN clip_id % 3 = 0 THEN ['nowhere'] ELSE ['someone', 'the', 'nowhere', 'der'] END AS asked FROM w),
k AS (SELECT *, list_filter(asked, lambda x: list_contains(words, x)) AS kept, CASE WHEN clip_id % 4 = 0 THEN '' ELSE rtrim(trim(a[1:80])[1:60]) END AS title FROM g)
SELECT clip_id, title, 'about' AS description, array_to_string(kept, ',') AS hashtags, CASE WHEN title = '' THEN 'no title' WHEN len(kept) = 0 THEN 'no supported hashtag' END AS problem FROM k""",
    "attached_words": f"""WITH {_E}, d AS (SELECT user_id AS clip_id, n AS segment_id FROM (SELECT DISTINCT user_id FROM s) u, range(0, 30) r(n)),
h AS (SELECT DISTINCT clip_id, segment_id, t, t + value * 60 AS stop, event_type FROM d JOIN s ON user_id = clip_id AND t < (segment_id + 1) * 86400.0 AND t + value * 60 > segment_id * 86400.0)
SELECT clip_id, segment_id::INTEGER AS segment_id, count(t)::INTEGER AS n, string_agg(event_type, ' ' ORDER BY t, stop, event_type) AS words FROM d LEFT JOIN h USING (clip_id, segment_id) GROUP BY ALL""",
    "transcripts": f"""WITH {_TIMED}, a AS (SELECT conv_id, start, stop, text FROM x WHERE conv_id % 2 = 1 UNION ALL SELECT conv_id, turn * 10.0::DOUBLE + 1, turn * 10.0::DOUBLE + 2, text FROM t WHERE conv_id % 2 = 0)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY start, stop, text) AS seq, round(start, 6) AS start, round(stop, 6) AS "end", text FROM a""",
    "karaoke_lines": f"""WITH {_TIMED}, k AS (SELECT conv_id, turn, string_agg('{{' || chr(92) || 'k' || greatest(1, round_even((stop - start) * 100, 0)::INT) || '}}' || {_SHOWN}, ' ' ORDER BY seq) AS line, string_agg({_SHOWN}, ' ' ORDER BY seq) AS plain FROM x GROUP BY ALL)
SELECT conv_id, turn, sha256(line) AS line_sha256, trim(replace(plain, chr(92) || 'N', ' ')) AS shown FROM k""",
    "silences": f"""WITH {_E}, m AS (SELECT user_id, seq, event_type, CASE event_type WHEN 'click' THEN round(t - 5, 3) ELSE round(t, 3) END AS at_ FROM s WHERE event_type IN ('click', 'view')),
l AS (SELECT *, lead(event_type) OVER w AS next, lead(at_) OVER w AS stop FROM m WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
p AS (SELECT user_id, greatest(at_, 0.0) AS start, CASE WHEN next IS NULL THEN 2592000.0 WHEN next = 'view' THEN stop END AS stop FROM l WHERE event_type = 'click')
SELECT user_id, round(start, 3) AS start, round(stop, 3) AS "end" FROM p WHERE stop > start""",
    "offset_warnings": f"""WITH {_E}, o AS (SELECT seq, floor(value) / 8 - 5 AS off, (floor(t / 3600)::BIGINT % 24) / 64 AS score FROM s)
SELECT seq, CASE WHEN score >= 0.05::DOUBLE AND abs(off) > 2.0::DOUBLE + 1e-9 THEN 'timelines differ by ' || CASE WHEN off < 0 THEN '-' ELSE '+' END || printf('%.1f', floor(abs(off) * 10 + 0.5) / 10) || 's (score ' || printf('%.2f', floor(score * 100 + 0.5) / 100) || ')' END AS warning FROM o""",
    "upscales": """WITH s AS (SELECT p_partkey, ((p_size - 1) * 60)::DOUBLE AS w, (p_size * 30)::DOUBLE AS h FROM part),
f AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN greatest(1.0, CASE WHEN p_partkey % 2 = 0 THEN least(1080 / w, 1920 / h) ELSE greatest(1080 / w, 1920 / h) * 1.25 END) ELSE 1.0 END AS factor FROM s)
SELECT p_partkey, round(factor, 6) AS factor, CASE WHEN w * h <= 0 THEN 'unknown_source_size' WHEN factor > 2 THEN 'upscale_exceeds_threshold' ELSE '' END AS warnings FROM f""",
    "media_ranges": f"""WITH {_E}, o AS (SELECT seq, t, value, CASE WHEN seq % 3 > 0 THEN (seq % 7 - 3) * 100000.0::DOUBLE ELSE 0 END AS off FROM s) SELECT seq, round(greatest(0.0, t + off), 6) AS media_start, round(greatest(0.0, t + value + off), 6) AS media_end FROM o""",
    "thumbnail_times": """WITH t AS (SELECT conv_id AS clip_id, turn * 10.0::DOUBLE AS a, turn * 10.0::DOUBLE + length(text) / 16 AS z FROM conversations),
l AS (SELECT clip_id, (a + z) / 2 AS middle FROM t WHERE clip_id % 5 > 0 QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY z - a DESC, a) = 1)
SELECT clip_id, round(greatest(0.0, least(coalesce(middle, 30.0), 60.0)), 6) AS at FROM (SELECT DISTINCT clip_id FROM t) c LEFT JOIN l USING (clip_id)""",
    "run_counters": f"WITH {EVENTS} SELECT user_id, count(*) AS seen, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS done, count(*) FILTER (WHERE event_type = 'view') AS skipped, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'signup') AS other FROM e GROUP BY 1",
    "changed_inputs": """SELECT p_partkey, sha256('{"p_size":' || p_size || ',"p_brand":"' || p_brand || '"}') AS fingerprint FROM part WHERE p_partkey % 3 = 0""",
    "read_documents": """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 0.0 ELSE round(o_totalprice, 3) END AS price, CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 4 = 0 THEN 'auto' ELSE o_orderstatus END AS status, 1.5::DOUBLE AS speed FROM orders""",
}
