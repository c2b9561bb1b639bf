"""From messages and levels to ranked candidates, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions.times import micros, whole
from tidemark.operators.fusion import fuse
from tidemark.operators.messages import keyword_hits
from tidemark.operators.rates import level_spikes, rate_spikes
from tidemark.operators.reasons import extract_reason
from tidemark.operators.sequences import coalesce_sessions, thin

KEY = ["stream_id"]


def keyword_details(of: Callable[[str], Column] = F.col) -> Column:
    """JSON of a keyword event; ``of`` gives its fields by name."""
    return F.to_json(F.struct(F.lit("keyword").alias("kind"), of("keyword").alias("keyword"), of("user").alias("user")))


def rate_details(of: Callable[[str], Column] = F.col) -> Column:
    """JSON of a rate event."""
    rounded = lambda c: F.round(of(c), 3)
    return F.to_json(F.struct(F.lit("rate_spike").alias("kind"), rounded("window_rate").alias("window_rate"), rounded("baseline_rate").alias("baseline_rate"), rounded("ratio").alias("multiplier"), of("window_count").alias("window_count")))


def chat_signals(messages: DataFrame, cfg: Settings = Settings(), peers: bool = False) -> DataFrame:
    """Keyword and rate events of messages (stream_id, seq, us, user, text): (stream_id, seq, us, kind, score, details).

    With ``peers``, messages of one instant count for each other, and go on together.
    """
    c = cfg.chat
    words = keyword_hits(messages, c.keywords).select(*KEY, "us", F.lit("keyword").alias("kind"), F.lit(c.keyword_score).alias("score"), "seq", keyword_details().alias("details"))
    rates = rate_spikes(messages, KEY, whole(c.window), whole(c.baseline), c.multiplier, c.min_rate, peers=peers)
    spikes = rates.select(*KEY, "us", F.lit("rate_spike").alias("kind"), F.lit(c.spike_score).alias("score"), "seq", rate_details().alias("details"))
    # Events of a kind have one score, so none replaces one before it.
    return thin(words.unionByName(spikes), [*KEY, "kind"], whole(c.dedupe_gap), peers=peers)


def audio_signals(levels: DataFrame, cfg: Settings = Settings(), peers: bool = False) -> DataFrame:
    """Level events of a series (stream_id, seq, us, value); with ``peers``, those of one instant go on together."""
    a = cfg.audio
    found = level_spikes(levels, KEY, max(1, int(a.baseline / a.frame)), a.multiplier, a.min_rms, whole(2 * a.frame), peers=peers)
    details = F.struct(F.lit("intensity_spike").alias("kind"), F.round("value", 5).alias("rms"), F.round("level", 5).alias("baseline"), F.round(F.col("value") / F.col("level"), 3).alias("multiplier"))
    return found.select(*KEY, "us", F.lit("intensity_spike").alias("kind"), F.lit(a.score).alias("score"), "seq", F.to_json(details).alias("details"))


def detect(messages: DataFrame, levels: DataFrame | None = None, cfg: Settings = Settings(), peers: bool = False) -> DataFrame:
    """Ranked candidates: stream_id, source_ts, score, kinds, event_count, signals (JSON), reason, pre, post.

    Any further detector is a DataFrame of (stream_id, seq, us, kind, score,
    details) and can be united with the chat signals.
    """
    chat = chat_signals(messages, cfg, peers)
    # Events at one instant keep their order: keyword before rate_spike.
    chat = chat.withColumn("seq", F.col("seq") * 2 + (F.col("kind") == "rate_spike").cast("long"))
    if levels is None:
        events = chat
    else:
        audio = audio_signals(levels, cfg, peers)
        one = fuse(chat, audio, KEY, whole(cfg.fusion.proximity), cfg.fusion.audio_weight, first_also=["kind", "details"], second_also=["details"])
        kind = F.when(F.col("kind") == "pair", "chat_audio").when(F.col("kind") == "first", F.col("first_kind")).otherwise("intensity_spike")
        pair = F.concat(F.lit('{"kind":"chat_audio","chat":'), F.col("first_details"), F.lit(',"audio":'), F.col("second_details"), F.lit("}"))
        events = one.select(*KEY, "us", kind.alias("kind"), "score", F.coalesce("first_seq", "second_seq").alias("seq"), F.coalesce(pair, "first_details", "second_details").alias("details"))
    found = coalesce_sessions(events, KEY, whole(cfg.fusion.coalesce_gap), payload=F.col("details"))
    return candidates(found, cfg)


def candidates(found: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Moments (stream_id, peak_us, peak_score, kinds, event_count, events: JSON of each) as candidates with their reason."""
    signals = F.concat(F.lit('{"kinds":'), F.to_json("kinds"), F.lit(',"event_count":'), F.col("event_count").cast("string"), F.lit(',"events":['), F.array_join("events", ","), F.lit("]}"))
    out = found.select(*KEY, (F.col("peak_us") / 1e6).alias("source_ts"), F.col("peak_score").alias("score"), "kinds", "event_count", signals.alias("signals"))
    return out.withColumns({"reason": extract_reason(F.col("signals")), "pre": F.lit(cfg.pre_context), "post": F.lit(cfg.post_context)})


def from_seconds(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """A table with seconds in ``ts`` as one with microseconds in ``us``."""
    return rows.withColumn("us", micros(F.col(ts)))
