"""Queries of the text operators over conversations, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.times import MICROS
from tidemark.operators import messages, metadata
from tidemark.queries.common import EVENTS, events, table

#: Searched in this order; the more specific first.
KEYWORDS = ("that the", "und der", "de la", "the", "der", "que")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.keyword_hits(_turns(spark, sf_dir), KEYWORDS).select("conv_id", "turn", "keyword")


def chat_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands within an hour of each user's best event, at most five messages, errors first."""
    e = events(spark, sf_dir)
    best = e.groupBy("user_id").agg(F.max_by("us", F.struct("value", -F.col("us"))).alias("us")).select(F.col("user_id").alias("moment_id"), F.lit(0).cast("long").alias("stream_id"), "us")
    said = e.select("stream_id", "us", "seq", F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("text"))
    return messages.context(best, said, ["error"], 5, 3600 * MICROS, 3600 * MICROS)["counts"]


def chat_context_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    best = e.groupBy("user_id").agg(F.max_by("us", F.struct("value", -F.col("us"))).alias("us")).select(F.col("user_id").alias("moment_id"), F.lit(0).cast("long").alias("stream_id"), "us")
    said = e.select("stream_id", "us", "seq", F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("text"))
    return messages.context(best, said, ["error"], 5, 3600 * MICROS, 3600 * MICROS)["messages"].select("moment_id", "us", "seq", "keyword")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("seq", F.struct("doc_id", "pos"))


def repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent lines of each language."""
    return messages.repeated_texts(_lines(spark, sf_dir), ["lang"]).select("lang", F.sha2("text", 256).alias("text_sha256"), "n", F.col("first_seq.doc_id").alias("first_doc"), F.col("first_seq.pos").alias("first_line"))


def hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return messages.hashtags(docs.select("source", "text"), ["source"], 6, F.col("source"), ["Thing", "#that", "nowhere-to-be"])


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.token_counts(_turns(spark, sf_dir), ["role"]).filter("n >= 3")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments of ten seconds, their words at equal widths."""
    turns = _turns(spark, sf_dir).select("conv_id", (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 10.0).alias("end"), "turn", "text")
    return messages.interpolate_words(turns, ["conv_id", "turn"])


def emphasis_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _words(spark, sf_dir).withColumn("seq", F.struct("turn", "seq"))
    return messages.emphasis_words(w, ["conv_id"], ["the", "que", "clip that"])


def words_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("conv_id", "turn", "seq", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = messages.cues(_words(spark, sf_dir).select("conv_id", "start", "end", "text"), ["conv_id"])
    return found.select("conv_id", "cue", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text")


def subtitle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated words as subtitle times and escaped texts."""
    w = _words(spark, sf_dir)
    return w.select("conv_id", "turn", "seq", tx.ass_time(F.col("start")).alias("at"), tx.ass_text(F.col("text")).alias("shown"), tx.word_form(F.col("text")).alias("form"), tx.ends_sentence(F.col("text")).alias("ends"))


def emote_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by whether they alone would say nothing."""
    return _words(spark, sf_dir).groupBy("conv_id", tx.is_emote_only(F.col("text")).alias("empty")).agg(F.count("*").alias("n"))


def fallback_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _turns(spark, sf_dir).groupBy(F.col("conv_id").alias("clip_id")).agg(F.max_by("text", -F.col("turn")).alias("transcript"), F.lit("").alias("caption"), F.lit("").alias("chat_text"), F.lit("someone").alias("login"))
    got = metadata.fallback(first)
    return got.select("clip_id", "title", "description", F.array_join("hashtags", ",").alias("hashtags"))


_TURNS = "t AS (SELECT conv_id, turn, role, text FROM conversations)"
_W = f"""{_TURNS}, p AS (SELECT conv_id, turn, turn * 10.0::DOUBLE AS s, string_split_regex(trim(text), '\\s+') AS parts FROM t WHERE trim(text) <> ''),
w AS (SELECT conv_id, turn, s, len(parts) AS n, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS seq FROM p)"""
_KW = ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^\\pL\\pM\\pN_]){k}($|[^\\pL\\pM\\pN_])') THEN '{k}' END" for k in KEYWORDS)
_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_CONTEXT = f"""{EVENTS}, b AS (SELECT user_id AS moment_id, us AS mid FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, us) = 1),
i AS (SELECT moment_id, mid, us, seq, CASE WHEN event_type = 'error' THEN 'error' END AS keyword FROM b JOIN e ON us BETWEEN mid - 3600000000 AND mid + 3600000000),
s AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY moment_id ORDER BY keyword IS NULL, abs(us - mid), us, seq) <= 5)"""
_TOKENS = "unnest(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS token"
_EDGE = """regexp_replace(regexp_replace(trim(text), '^[.,!?"''()\\[\\]]+', ''), '[.,!?"''()\\[\\]]+$', '')"""
_EMO = ", ".join(f"'{w}'" for w in tx.EMOTION_WORDS)

#: Words with their times; a word's place in a turn gives both.
_TIMED = f"""{_W}, x AS (SELECT conv_id, turn, seq, s + seq * (10.0::DOUBLE / n) AS start, s + (seq + 1) * (10.0::DOUBLE / n) AS stop, text FROM w)"""
_SENTENCE = "regexp_matches(rtrim({}), '[.!?…]$')"
_CUES = f"""WITH RECURSIVE {_TIMED},
y AS (SELECT *, row_number() OVER o AS rn, coalesce(start - lag(stop) OVER o >= 0.35::DOUBLE OR {_SENTENCE.format("lag(text) OVER o")}, TRUE) AS fresh FROM x WINDOW o AS (PARTITION BY conv_id ORDER BY start, stop, text)),
pk AS (SELECT conv_id, rn, 1 AS cue, start, greatest(stop, start) AS stop, length(text) AS chars, text FROM y WHERE rn = 1
 UNION ALL
 SELECT y.conv_id, y.rn, CASE WHEN full_ THEN pk.cue + 1 ELSE pk.cue END, CASE WHEN full_ THEN y.start ELSE pk.start END, CASE WHEN full_ THEN greatest(y.stop, y.start) ELSE greatest(y.stop, pk.start) END,
        CASE WHEN full_ THEN length(y.text) ELSE pk.chars + 1 + length(y.text) END, y.text
 FROM pk JOIN y ON y.conv_id = pk.conv_id AND y.rn = pk.rn + 1, LATERAL (SELECT y.fresh OR pk.chars + 1 + length(y.text) > 36 OR y.stop - pk.start > 2.2::DOUBLE AS full_) l),
c AS (SELECT conv_id, cue, min(start) AS start, arg_max(stop, rn) AS stop, string_agg(text, ' ' ORDER BY rn) AS text FROM pk GROUP BY ALL),
o AS (SELECT *, CASE WHEN start >= max(stop) OVER (PARTITION BY conv_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS opens FROM c),
i AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM o),
m AS (SELECT conv_id, island, min(start) AS start, arg_max(stop, {{'a': start, 'b': stop}}) AS stop, string_agg(text, ' ' ORDER BY start, stop) AS text FROM i GROUP BY ALL),
s AS (SELECT conv_id, island, start, greatest(stop, start + 0.5::DOUBLE) AS stop, text, lead(start) OVER (PARTITION BY conv_id ORDER BY start, island) AS next FROM m)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY start, island) AS cue, round(start, 6) AS start, round(CASE WHEN next IS NULL THEN stop ELSE least(stop, greatest(start, next)) END, 6) AS "end", text FROM s"""
_FIRST = lambda n: f"array_to_string(string_split(regexp_replace(trim(said), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:{n}], ' ')"
_FALLBACK = f"""WITH {_TURNS}, f AS (SELECT conv_id AS clip_id, arg_min(text, turn) AS said FROM t GROUP BY 1),
k AS (SELECT clip_id, unnest(regexp_extract_all(lower(said), '([a-z0-9_]+)', 1)) AS token FROM f),
a AS (SELECT clip_id, token AS tag, 2 AS rank, -count(*) AS weight FROM k WHERE length(token) >= 4 AND token NOT IN ({_STOP}) AND NOT regexp_full_match(token, '[0-9]+') GROUP BY ALL UNION ALL SELECT clip_id, 'someone', 0, 0 FROM f),
b AS (SELECT clip_id, tag, min(rank * 1000000000000 + weight) AS o FROM a GROUP BY ALL),
h AS (SELECT clip_id, string_agg(tag, ',' ORDER BY o, tag) AS hashtags FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY o, tag) <= 6) z GROUP BY clip_id)
SELECT clip_id, rtrim({_FIRST(1)}[1:60]) AS title, trim({_FIRST(2)} || ' (via someone)') AS description, hashtags FROM f JOIN h USING (clip_id)"""

QUERIES = {f.__name__: f for f in (keyword_hits, chat_context, chat_context_messages, repeated_texts, hashtags, token_counts, emphasis_words, words_interpolated, cues, subtitle_lines, emote_only, fallback_metadata)}
ORACLE_SQL = {
    "keyword_hits": f"WITH {_TURNS} SELECT conv_id, turn, keyword FROM (SELECT *, coalesce({_KW}) AS keyword FROM t) WHERE keyword IS NOT NULL",
    "chat_context": f"WITH {_CONTEXT} SELECT moment_id, count(*) AS window_count, least(count(*), 5)::BIGINT AS shown, (SELECT count(keyword) FROM s WHERE s.moment_id = i.moment_id) AS keyword_hits FROM i GROUP BY moment_id",
    "chat_context_messages": f"WITH {_CONTEXT} SELECT moment_id, us, seq, keyword FROM s",
    "repeated_texts": """WITH l AS (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
c AS (SELECT lang, lower(trim(line)) AS text, count(*) AS n, min({'d': doc_id, 'p': pos}) AS first FROM l WHERE trim(line) <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first) AS rn FROM c)
SELECT lang, sha256(text) AS text_sha256, n, first.d AS first_doc, first.p AS first_line FROM r WHERE rn <= 5 AND n >= 2""",
    "hashtags": f"""WITH d AS (SELECT source, text FROM documents), k AS (SELECT source, {_TOKENS} FROM d),
c AS (SELECT source, token AS tag, 2 AS rank, -count(*) AS weight FROM k WHERE length(token) >= 4 AND token NOT IN ({_STOP}) AND NOT regexp_full_match(token, '[0-9]+') GROUP BY ALL),
a AS (SELECT * FROM c UNION ALL SELECT DISTINCT source, token, 1, CASE token WHEN 'thing' THEN 0 ELSE 1 END FROM k WHERE token IN ('thing', 'that') UNION ALL SELECT DISTINCT source, lower(source), 0, 0 FROM d),
b AS (SELECT source, tag, min(rank * 1000000000000 + weight) AS o FROM a GROUP BY ALL),
n AS (SELECT source, tag, CAST(row_number() OVER (PARTITION BY source ORDER BY o, tag) AS INTEGER) AS place FROM b) SELECT source, place, tag FROM n WHERE place <= 6""",
    "token_counts": f"WITH {_TURNS}, k AS (SELECT role, {_TOKENS} FROM t) SELECT role, token, count(*) AS n FROM k WHERE length(token) >= 4 AND token NOT IN ({_STOP}) AND NOT regexp_full_match(token, '[0-9]+') GROUP BY ALL HAVING count(*) >= 3",
    "emphasis_words": f"""WITH {_W}, c AS (SELECT conv_id, {{'t': turn, 's': seq}} AS seq, {_EDGE} AS core FROM w),
x AS (SELECT conv_id, seq, lower(core) AS word, CASE WHEN length(core) > 1 AND regexp_matches(core, '\\p{{Lu}}') AND NOT regexp_matches(core, '\\p{{Ll}}') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(core, '[0-9]') THEN 2 ELSE 0 END
 + CASE WHEN lower(core) IN ('the', 'que') THEN 2 ELSE 0 END + CASE WHEN lower(core) IN ({_EMO}) THEN 2 ELSE 0 END + CASE WHEN length(core) >= 9 THEN 1 ELSE 0 END AS score FROM c WHERE core <> ''),
s AS (SELECT conv_id, word, CAST(sum(score) AS BIGINT) AS score, min(seq) AS first FROM x WHERE score > 0 GROUP BY ALL),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, first, word) AS INTEGER) AS place FROM s) SELECT conv_id, place, word, score FROM n WHERE place <= 12""",
    "words_interpolated": f'WITH {_W} SELECT conv_id, turn, seq, round(s + seq * (10.0::DOUBLE / n), 6) AS start, round(s + (seq + 1) * (10.0::DOUBLE / n), 6) AS "end", text FROM w',
    "cues": _CUES,
    "subtitle_lines": f"""WITH {_TIMED}, z AS (SELECT *, round_even(greatest(start, 0.0) * 100, 0)::BIGINT AS c FROM x)
SELECT conv_id, turn, seq, printf('%d:%02d:%02d.%02d', c // 360000, c // 6000 % 60, c // 100 % 60, c % 100) AS at, regexp_replace(translate(replace(text, chr(92), chr(92) || chr(92)), '{{}}', '()'), '[\\r\\n]+', ' ', 'g') AS shown,
 lower({_EDGE}) AS form, {_SENTENCE.format("text")} AS ends FROM z""",
    "fallback_metadata": _FALLBACK,
    "emote_only": f"""WITH {_W}, c AS (SELECT conv_id, regexp_replace(regexp_replace(lower(text), '^[!?.]+', ''), '[!?.]+$', '') AS core FROM w)
SELECT conv_id, core IN ({", ".join(f"'{x}'" for x in tx.EMOTES)}) OR NOT regexp_matches(core, '[\\pL\\pN]') AS empty, count(*) AS n FROM c GROUP BY 1, 2""",
}
