"""Why a candidate was flagged, in words, from its signals.

Signals are JSON text: an event itself, with ``kinds``, ``events`` and nested
``chat`` and ``audio`` events; fields may be missing or of another type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = "struct<kind:string,keyword:string,user:string,multiplier:string,window_rate:string,baseline_rate:string>"
NESTED = f"struct<kind:string,keyword:string,user:string,multiplier:string,window_rate:string,baseline_rate:string,chat:{EVENT},audio:{EVENT}>"
SIGNALS = f"{NESTED[:-1]},kinds:array<string>,events:array<{NESTED}>>"
#: What is named first where no event has details.
PRIORITY = ("keyword", "rate_spike", "intensity_spike", "chat_audio")
PLAIN = "Flagged by detection signals"


def extract_reason(signals: Column) -> Column:
    """One line per candidate: keyword, rate and level parts joined, or the kind that flagged it."""
    s = F.from_json(signals, SIGNALS)
    bare = lambda e: F.struct(*(e[f].alias(f) for f in ("kind", "keyword", "user", "multiplier", "window_rate", "baseline_rate")))
    inner = F.flatten(F.transform(F.coalesce(s["events"], F.array().cast(f"array<{NESTED}>")), lambda e: F.array_compact(F.array(bare(e), e["chat"], e["audio"]))))
    events = F.array_compact(F.concat(F.array(bare(s)), inner, F.array(s["chat"], s["audio"])))
    of = lambda kind: F.try_element_at(F.filter(events, lambda e: e["kind"] == kind), F.lit(1))
    kinds = F.array_distinct(F.filter(F.concat(F.coalesce(s["kinds"], F.array().cast("array<string>")), F.transform(events, lambda e: e["kind"])), lambda k: k.isNotNull() & (k != "")))
    number = lambda c: c.try_cast("double")
    keyword = F.coalesce(of("keyword"), F.when(F.coalesce(s["keyword"], F.lit("")) != "", bare(s)))
    word = F.when(F.coalesce(keyword["keyword"], F.lit("")) != "", keyword["keyword"]).otherwise("clip")
    said = F.when(keyword.isNull(), F.lit("Chat asked to clip it")).when(F.coalesce(keyword["user"], F.lit("")) != "", F.format_string('Chat asked to clip it ("%s" from %s)', word, keyword["user"])).otherwise(F.format_string('Chat asked to clip it ("%s")', word))
    spike, audio = of("rate_spike"), of("intensity_spike")
    times = F.coalesce(number(spike["multiplier"]), F.try_divide(number(spike["window_rate"]), number(spike["baseline_rate"])))
    rate = F.when(times.isNull(), "Chat rate jumped vs the last minute").otherwise(F.format_string("Chat rate jumped %.1fx vs the last minute", times))
    loud = F.when(number(audio["multiplier"]).isNull(), "Audio got louder than the recent baseline").otherwise(F.format_string("Audio got %.1fx louder than the recent baseline", number(audio["multiplier"])))
    has = lambda kind: F.array_contains(kinds, kind)
    parts = F.array_compact(F.array(F.when(keyword.isNotNull() | has("keyword"), said), F.when(has("rate_spike"), rate), F.when(has("intensity_spike"), loud)))
    best = F.coalesce(F.when(F.coalesce(s["kind"], F.lit("")) != "", s["kind"]), *(F.when(has(k), F.lit(k)) for k in PRIORITY), F.array_min(kinds))
    fallback = F.when(best.isNotNull(), F.format_string("Flagged by %s signal", F.replace(best, F.lit("_"), F.lit(" ")))).otherwise(PLAIN)
    return F.when(s.isNull(), PLAIN).when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(fallback)


def with_reason(candidates: DataFrame, signals: str = "signals") -> DataFrame:
    return candidates.withColumn("extract_reason", extract_reason(F.col(signals)))
