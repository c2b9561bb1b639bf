"""Titles, descriptions and hashtags of clips, made from what was said or checked against it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Metadata
from tidemark.functions import text as tx
from tidemark.operators.messages import hashtags


def _shorten(text, most: int):
    return F.rtrim(F.substring(text, 1, most))


def fallback(clips: DataFrame, keywords: Sequence[str] = (), cfg: Metadata = Metadata()) -> DataFrame:
    """Metadata of clips (clip_id, caption, transcript, chat_text, login) without a model."""
    said = F.coalesce("transcript", F.lit(""))
    title = F.when(F.coalesce(F.trim("caption"), F.lit("")) != "", F.trim("caption")).otherwise(tx.first_sentences(said, 1))
    about = F.trim(F.concat(tx.first_sentences(said, 2), F.when(F.coalesce("login", F.lit("")) != "", F.concat(F.lit(" (via "), F.col("login"), F.lit(")"))).otherwise("")))
    source = clips.select("clip_id", "login", F.concat_ws(" ", "transcript", "chat_text").alias("text"))
    tags = hashtags(source, ["clip_id"], cfg.max_hashtags, F.coalesce("login", F.lit("")), keywords).groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda t: t["tag"]).alias("hashtags"))
    return clips.select("clip_id", _shorten(title, cfg.title_max_chars).alias("title"), about.alias("description")).join(tags, "clip_id", "left").withColumn("hashtags", F.coalesce("hashtags", F.array().cast("array<string>")))


def validate(proposals: DataFrame, clips: DataFrame, cfg: Metadata = Metadata()) -> DataFrame:
    """Proposals (clip_id, title, description, hashtags) cut to size; tags must occur in what was said, else the proposal is rejected."""
    words = tx.tokens(F.concat_ws(" ", "transcript", "chat_text", "login"))
    j = proposals.join(clips.select("clip_id", F.array_distinct(words).alias("words")), "clip_id")
    tags = F.filter(F.transform("hashtags", tx.hashtag), lambda t: t != "")
    kept = tx.keep_allowed(tags, F.col("words"), cfg.max_hashtags)
    out = j.select("clip_id", _shorten(tx.strip_quotes(F.coalesce("title", F.lit(""))), cfg.title_max_chars).alias("title"), F.trim(F.coalesce("description", F.lit(""))).alias("description"), F.coalesce(kept, F.array().cast("array<string>")).alias("hashtags"))
    problem = F.when(F.col("title") == "", "no title").when(F.size("hashtags") == 0, "no supported hashtag")
    return out.withColumn("problem", problem)


def emphasis_from_answer(answers: DataFrame, words: DataFrame, limit: int = 12) -> DataFrame:
    """Answered words (clip_id, answer) that the transcript (clip_id, text per word) holds, first seen first."""
    forms = words.groupBy("clip_id").agg(F.collect_set(tx.word_form(F.col("text"))).alias("forms"))
    return answers.join(forms, "clip_id", "left").select("clip_id", tx.keep_allowed(tx.word_forms(F.col("answer")), F.coalesce("forms", F.array().cast("array<string>")), limit).alias("words"))


def caption_outcome(clips: DataFrame, enabled: bool = True, has_key: bool = True) -> DataFrame:
    """Why a clip gets no captions (``reason``), or null: the first gate that holds (columns has_clip, has_transcript, n_cues)."""
    reason = F.when(F.lit(not enabled), "captions disabled").when(F.lit(not has_key), "no transcription key").when(~F.col("has_clip"), "no clip").when(~F.col("has_transcript"), "no transcript").when(F.col("n_cues") == 0, "no cues")
    return clips.withColumn("reason", reason)


