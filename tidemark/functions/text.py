"""Text functions of messages, words, cues and documents."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that results depend on.

#: Messages that say nothing beyond an emote.
EMOTES = (
    "kekw", "kek", "lul", "lol", "lmao", "pog", "poggers", "pogchamp", "omegalul", "sadge",
    "copium", "based", "sheesh", "nice", "f", "gg", "pepe", "pepega", "monkas", "jebaited",
)

#: Words that carry emotion in a caption.
EMOTION_WORDS = (
    "crazy", "insane", "unreal", "unbelievable", "never", "impossible", "actually", "finally", "literally", "what",
    "stop", "wait", "look", "help", "wow", "holy", "bro", "dude", "clutch", "cooked", "ripped", "wild", "caught",
    "banned", "broke", "money", "win", "won", "lost", "died",
)

#: Words that make no hashtag.
STOPWORDS = (
    "the", "and", "for", "that", "this", "with", "you", "your", "have", "just", "about", "there", "what", "when", "then",
    "them", "they", "from", "into", "like", "some", "been", "were", "will", "would", "could", "should", "here", "gonna",
    "really", "right", "well", "yeah", "okay", "know", "mean", "want", "gotta", "talk", "come", "came", "make", "made",
    "much", "very", "lot", "get", "got", "let", "lets", "one", "two", "three",
)


def keyword_pattern(keyword: str) -> str:
    """Java pattern of a whole keyword; word characters are Unicode's."""
    return r"(?U)(?<!\w)\Q" + keyword.lower().replace(r"\E", r"\E\\E\Q") + r"\E(?!\w)"


def first_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """The first keyword, in the order listed, that stands in the lower-cased text as a whole; else null."""
    found = [F.when(F.lower(text).rlike(keyword_pattern(k.strip())), F.lit(k)) for k in keywords if k.strip()]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def is_emote_only(text: Column) -> Column:
    """Blank, or one token that is a known emote or has no letter or digit."""
    token = F.regexp_replace(F.lower(F.trim(text)), r"^[!?.]+|[!?.]+$", "")
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    one = ~F.trim(text).rlike(r"(?U)\s")
    return blank | (one & (token.isin(*EMOTES) | ~token.rlike(r"(?U)[\p{L}\p{N}]")))


def hashtag(text: Column) -> Column:
    """A tag of ``[a-z0-9_]`` only."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(text), "^#+", "")), "[^a-z0-9_]", "")


def hashtag_unicode(text: Column) -> Column:
    """A tag that keeps letters and digits of any script."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(text), "^#+", "")), r"[^\p{L}\p{N}_]", "")


def word_form(text: Column) -> Column:
    """A word without its punctuation, in lower case."""
    return F.lower(F.regexp_replace(F.trim(text), r"""^[.,!?"'()\[\]]+|[.,!?"'()\[\]]+$""", ""))


def word_forms(text: Column) -> Column:
    """Word forms of a free answer, in order, blanks left out."""
    return F.filter(F.transform(F.split(text, r"[^0-9A-Za-z']+"), word_form), lambda w: w != "")


def keep_allowed(words: Column, allowed: Column, most: int) -> Column:
    """Distinct words in first-seen order that ``allowed`` holds, at most ``most``."""
    return F.slice(F.array_intersect(words, allowed), 1, most)


def ends_sentence(text: Column) -> Column:
    return F.coalesce(F.rtrim(text).rlike("[.!?…]$"), F.lit(False))


def strip_quotes(text: Column) -> Column:
    """Without one pair of matching quotes around the whole."""
    return F.trim(F.regexp_replace(F.trim(text), r"""(?s)^(["'])(.*)\1$""", "$2"))


def first_sentences(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"(?<=[.!?])\s+"), 1, n), " ")


def json_object_text(text: Column) -> Column:
    """From the first ``{`` to the last ``}`` if that parses as JSON, else ``{}``."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found).otherwise(F.lit("{}"))


def tokens(text: Column) -> Column:
    """Runs of ``[a-z0-9_]`` of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), 1)


# -- subtitles ---------------------------------------------------------------


def ass_text(text: Column) -> Column:
    """Text safe in a subtitle line."""
    return F.regexp_replace(F.translate(F.replace(text, F.lit("\\"), F.lit("\\\\")), "{}", "()"), r"[\r\n]+", " ")


def ass_time(seconds: Column) -> Column:
    """``H:MM:SS.cc``, halves to even."""
    centis = F.bround(F.greatest(seconds, F.lit(0.0)) * 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(centis / 360000), F.floor(centis / 6000) % 60, F.floor(centis / 100) % 60, centis % 100)


def karaoke(words: Column, upper: bool = False) -> Column:
    """Words (struct start, end, text) with their durations as karaoke tags."""
    shown = lambda w: F.upper(ass_text(F.trim(w["text"]))) if upper else ass_text(F.trim(w["text"]))
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit("{\\k"), F.greatest(F.lit(1), F.bround((w["end"] - w["start"]) * 100).cast("int")).cast("string"), F.lit("}"), shown(w))), " ")


def plain_line(text: Column) -> Column:
    """What a subtitle line shows: tags gone, breaks as spaces."""
    return F.trim(F.replace(F.regexp_replace(text, r"\{[^}]*\}", ""), F.lit("\\N"), F.lit(" ")))


# -- media names -------------------------------------------------------------


def rational(text: Column) -> Column:
    """``a/b`` or a number, as a double of three digits; null if neither."""
    top, bottom = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")
    return F.round(F.when(text.contains("/"), F.try_divide(top, bottom)).otherwise(text.try_cast("double")), 3)


def recording_name(text: Column) -> Column:
    """File name for a recording: the last path part, other characters than letters, digits, ``-`` and ``_`` replaced."""
    last = F.regexp_extract(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "/+$", ""), "([^/]*)$", 1)
    return F.concat(F.regexp_replace(F.when(last == "", F.lit("vod")).otherwise(last), r"[^\p{L}\p{N}_-]", "_"), F.lit(".ts"))


def video_url(text: Column, site: str = "https://www.twitch.tv") -> Column:
    """A full address, ``videos/<n>``, a bare number or a channel as an address; null for blanks."""
    raw = F.trim(text)
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None).cast("string"))
        .when(raw.rlike("^https?://"), raw)
        .when(raw.startswith("videos/") | ~raw.rlike("^[0-9]+$"), F.concat(F.lit(site + "/"), raw))
        .otherwise(F.concat(F.lit(site + "/videos/"), raw))
    )


def downloader_name(text: Column) -> Column:
    """The tool's canonical name; null where it is unknown."""
    raw = F.replace(F.lower(F.trim(F.coalesce(text, F.lit("streamlink")))), F.lit("-"), F.lit("_"))
    return F.when(raw.isin("streamlink", "yt_dlp"), raw)


def format_selector(quality: Column) -> Column:
    """A quality (best, worst, audio, 720p60, ...) as a download format."""
    raw = F.lower(F.trim(F.coalesce(quality, F.lit("best"))))
    high = F.regexp_replace(F.split_part(raw, F.lit("p"), F.lit(1)), "[^0-9]", "")
    return (
        F.when(raw == "worst", F.lit("worst"))
        .when(raw.isin("audio_only", "audio"), F.lit("ba/b"))
        .when(raw.isin("best", "bestvideo", "source", "high") | (high == ""), F.lit("bv*+ba/b"))
        .otherwise(F.concat(F.lit("bv*[height<="), high, F.lit("]+ba/b[height<="), high, F.lit("]")))
    )


def filter_path(path: Column) -> Column:
    """A path as an argument within a filter graph."""
    return F.replace(F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit(":"), F.lit("\\:")), F.lit("'"), F.lit("\\'"))


def like_any(text: Column, parts: Sequence[str]) -> Column:
    return text.rlike("|".join(re.escape(p) for p in parts)) if parts else F.lit(False)
