"""Where a clip begins and ends: evidence per candidate, then a chain of rules.

Candidates are rows (candidate_id, source_ts, pre, post) in seconds.  Evidence
is joined by candidate_id: words (start, end, text), chat times (t) and levels
(t, value), already on the candidate's clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Bounds, ChatRates
KEY = ["candidate_id"]


def review_window(candidates: DataFrame, cfg: Bounds = Bounds()) -> DataFrame:
    """The detection window, clamped to the allowed length around its moment."""
    start, end, at = F.greatest(F.lit(0.0), F.col("source_ts") - F.col("pre")), F.col("source_ts") + F.col("post"), F.col("source_ts")
    size = F.when(end - start > cfg.max_seconds, cfg.max_seconds).when(end - start < cfg.min_seconds, cfg.min_seconds)
    low = F.when(size.isNotNull(), F.greatest(F.lit(0.0), at - size / 2)).otherwise(start)
    out = candidates.withColumn("start", low).withColumn("end", F.when(size.isNotNull(), F.col("start") + size).otherwise(end))
    main = F.least(F.greatest(at, F.col("start")), F.col("end"))
    return out.withColumn("main_ts", main).withColumn("hook_ts", F.greatest(F.col("start"), F.col("main_ts") - cfg.hook_lookback)).withColumn("payoff_ts", F.least(F.col("end"), F.col("main_ts") + cfg.reaction_tail))


def burst_end(candidates: DataFrame, chat: DataFrame, rate: ChatRates = ChatRates(), search: float = 3.0) -> DataFrame:
    """Last sampled moment from the peak on at which messages still come at the least rate; (candidate_id, burst_end)."""
    w = max(0.5, rate.window)
    step, reach = max(0.5, w / 2), max(w, search)
    near = candidates.select("candidate_id", "source_ts").join(chat, KEY).filter(F.col("t").between(F.col("source_ts") - w, F.col("source_ts") + reach)).select("candidate_id", "source_ts", F.col("t"))
    # A message counts for the moments m with m - w < t <= m: a few per message, so no spine is joined.
    # Those beside them are asked too, as sums of doubles may round across an edge.
    first = F.greatest(F.lit(1), F.ceil((F.col("t") - F.col("source_ts")) / step) - 1)
    last = F.least(F.lit(int(reach / step + 1e-9)), F.ceil((F.col("t") + w - F.col("source_ts")) / step) + 1)
    asked = near.select("candidate_id", "source_ts", "t", F.explode(F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))).alias("k"))
    moment = F.col("source_ts") + step * F.col("k")
    moments = asked.filter((F.col("t") > moment - w) & (F.col("t") <= moment))
    counts = moments.groupBy("candidate_id", "source_ts", "k").agg(F.count("*").alias("n")).filter(F.col("n") / w >= rate.min_rate).groupBy("candidate_id").agg(F.max("k").alias("k"))
    some = near.groupBy("candidate_id").agg(F.first("source_ts").alias("source_ts"))
    return some.join(counts, KEY, "left").select("candidate_id", F.least(F.col("source_ts") + F.coalesce(F.col("k") * step, F.lit(0.0)), F.col("source_ts") + search).alias("burst_end"))


def level_decay(candidates: DataFrame, levels: DataFrame, baseline: float = 30.0, min_rms: float = 0.02, search: float = 3.0, factor: float = 1.5) -> DataFrame:
    """First level after the peak below ``factor`` times the median before it; (candidate_id, decay)."""
    joined = candidates.select("candidate_id", "source_ts").join(levels, KEY)
    base = joined.filter(F.col("t").between(F.col("source_ts") - baseline, F.col("source_ts"))).groupBy("candidate_id").agg(F.median("value").alias("base"))
    after = joined.filter(F.col("t").between(F.col("source_ts"), F.col("source_ts") + search)).join(base, KEY, "left")
    below = F.col("value") < F.greatest(F.lit(min_rms), factor * F.coalesce("base", F.lit(min_rms)))
    return after.groupBy("candidate_id").agg(F.min(F.when(below, F.col("t"))).alias("decay")).filter("decay is not null")


def within(evidence: DataFrame, candidates: DataFrame, overlap: bool = False) -> DataFrame:
    """Evidence of each candidate's window: times in it (ends included), or spans that overlap it."""
    low, high = F.greatest(F.lit(0.0), F.col("source_ts") - F.col("pre")), F.col("source_ts") + F.col("post")
    joined = evidence.join(candidates.select("candidate_id", "source_ts", "pre", "post"), KEY)
    return joined.filter((F.col("end") > low) & (F.col("start") < high) if overlap else F.col("t").between(low, high)).select(*evidence.columns)


def constrain(df: DataFrame, cfg: Bounds = Bounds()) -> DataFrame:
    """The hard rules on (start, end) with main_ts, payoff_ts, floor and ceiling; adds ``rules``, those that acted.

    In order: not after the main event; the payoff inside; the ceiling trims the
    start first, but keeps the least context; the floor extends forward where
    there is room, else backward.
    """
    top, low = max(cfg.min_seconds, cfg.max_seconds), min(cfg.min_seconds, max(cfg.min_seconds, cfg.max_seconds))
    s, e, main, pay = (F.col(c) for c in ("start", "end", "main_ts", "payoff_ts"))
    floor, ceiling = F.col("floor"), F.col("ceiling")
    note = lambda on, text: F.when(F.col(on), F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    out = df.withColumns({"start": F.least(s, e), "end": F.greatest(s, e)})
    out = out.withColumn("late", s > main).withColumn("start", F.when(F.col("late"), F.greatest(floor, main - cfg.min_context)).otherwise(s))
    out = out.withColumn("open", e < pay).withColumn("end", F.greatest(e, pay))
    latest = F.greatest(floor, main - cfg.min_context)
    moved = F.least(F.greatest(s, e - top), latest)
    out = out.withColumn("trim_start", (e - s > top) & (moved > s)).withColumn("start", F.when(F.col("trim_start"), moved).otherwise(s))
    out = out.withColumn("trim_end", e - s > top).withColumn("end", F.when(F.col("trim_end"), s + top).otherwise(e))
    out = out.withColumn("short", e - s < low).withColumn("room", F.least(ceiling, s + low) - s >= low)
    out = out.withColumn("start", F.when(F.col("short") & ~F.col("room"), F.least(s, F.greatest(floor, e - low))).otherwise(s))
    out = out.withColumn("end", F.when(F.col("short"), F.least(ceiling, s + low)).otherwise(e))
    out = out.withColumn("start", F.greatest(floor, s)).withColumn("end", F.least(ceiling, F.greatest(e, s)))
    rules = F.concat(
        note("late", "start moved back before the main event"), note("open", "end extended to the payoff"), note("trim_start", "start trimmed to the ceiling"),
        note("trim_end", "end trimmed to the ceiling"), note("short", "extended to the minimum length"),
    )
    return out.withColumn("rules", rules).drop("late", "open", "trim_start", "trim_end", "short", "room")


def _gathered(candidates: DataFrame, evidence: DataFrame, name: str, order: list[str], overlap: bool = False) -> DataFrame:
    """(candidate_id, array of the evidence in its window): as long as the window, however long the stream."""
    return within(evidence, candidates, overlap).groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias(name))


def median_of(values: Column) -> Column:
    """Median of an array of numbers, null of an empty one."""
    v, n = F.array_sort(values), F.size(values)
    low, high = F.try_element_at(v, F.floor((n + 1) / 2).cast("int")), F.try_element_at(v, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def _joined_words(words: Column, gap: float) -> Column:
    """Words (start, end), sorted, less than ``gap`` apart as one utterance (start, end)."""

    def step(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], w["end"]).alias("end"))
        new = F.struct(w["start"].alias("start"), w["end"].alias("end"))
        return F.when(F.coalesce(w["start"] - last["end"] < gap, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(new)))

    return F.aggregate(words, F.array().cast("array<struct<start:double,end:double>>"), step)


def _snapped(at: Column, words: Column, gaps: Column, edge: str, tolerance: float, to: str) -> Column:
    """The end ``to`` of a word that holds the time, else the nearest gap edge within tolerance, else the time."""
    word = F.try_element_at(F.filter(words, lambda w: (w["start"] < at) & (at < w["end"])), F.lit(1))
    near = F.array_min(F.transform(gaps, lambda x: F.struct(F.abs(x[edge] - at).alias("d"), x[edge].alias("edge"))))
    return F.when(word.isNotNull(), word[to]).when((near["d"] > 0) & (near["d"] <= tolerance), near["edge"]).otherwise(at)


def decide(candidates: DataFrame, words: DataFrame, chat: DataFrame, levels: DataFrame, cfg: Bounds = Bounds(), rate: ChatRates = ChatRates(), min_rms: float = 0.02, baseline: float = 30.0) -> DataFrame:
    """Final bounds of every candidate from whatever evidence it has; without any, the review window.

    Each kind of evidence is gathered once per candidate; what follows is
    expressions on arrays, so the plan has one exchange per input.  Returns
    candidate_id, start, end, main_ts, hook_ts, payoff_ts, method, the evidence
    (main_end, burst_end, decay, natural_end) and the rules that acted.
    """
    at, tail = F.col("source_ts"), max(0.0, cfg.reaction_tail)
    out = candidates.withColumn("floor", F.greatest(F.lit(0.0), at - F.col("pre"))).withColumn("ceiling", at + F.col("post"))
    words = words.withColumns({"start": F.col("start").cast("double"), "end": F.col("end").cast("double")})
    for df, name, order, overlap in ((words, "words", ["start", "end"], True), (chat, "chat", ["t"], False), (levels, "levels", ["t", "value"], False)):
        out = out.join(_gathered(candidates, df, name, order, overlap), KEY, "left")
    none = F.array()
    out = out.withColumns({"evidence": F.col("words").isNotNull() | F.col("chat").isNotNull() | F.col("levels").isNotNull(), "words": F.filter(F.coalesce("words", none.cast("array<struct<start:double,end:double>>")), lambda w: w["end"] > w["start"])})
    out = out.withColumn("said", _joined_words(F.col("words"), cfg.utterance_gap))
    low, high = F.col("floor"), F.col("ceiling")
    heads = F.transform("said", lambda u, i: F.struct(F.greatest(F.when(i > 0, F.try_element_at(F.col("said"), i)["end"]).otherwise(low), low).alias("start"), F.least(u["start"], high).alias("end")))
    rest = F.array(F.struct(F.greatest(F.try_element_at("said", F.lit(-1))["end"], low).alias("start"), high.alias("end")))
    quiet = F.when(F.size("said") > 0, F.filter(F.concat(heads, rest), lambda x: x["end"] > x["start"])).otherwise(none.cast("array<struct<start:double,end:double>>"))
    numbered = F.transform("said", lambda u, i: F.struct(u["start"].alias("start"), u["end"].alias("end"), F.when(i > 0, F.try_element_at(F.col("said"), i)["start"]).alias("previous")))
    main = F.try_element_at(F.filter(numbered, lambda u: (u["start"] <= at) & (at <= u["end"])), F.lit(1))
    out = out.withColumns({"quiet": quiet, "main": main})
    w = max(0.5, rate.window)
    step, reach = max(0.5, w / 2), max(w, tail)
    lasting = lambda k: F.size(F.filter("chat", lambda c: (c["t"] > at + k * step - w) & (c["t"] <= at + k * step))) / w >= rate.min_rate
    moments = F.filter(F.sequence(F.lit(0), F.lit(int(reach / step + 1e-9))), lambda k: (k == 0) | lasting(k))
    near = F.exists("chat", lambda c: c["t"].between(at - w, at + reach))
    burst = F.when(F.coalesce(near, F.lit(False)), F.least(at + F.array_max(moments) * step, at + tail))
    base = median_of(F.transform(F.filter("levels", lambda x: x["t"].between(at - baseline, at)), lambda x: x["value"]))
    out = out.withColumns({"burst_end": burst, "level": F.greatest(F.lit(min_rms), 1.5 * F.coalesce(base, F.lit(min_rms))), "main_ts": at, "main_end": F.greatest(at, F.coalesce("main.end", at))})
    out = out.withColumn("decay", F.array_min(F.transform(F.filter("levels", lambda x: x["t"].between(at, at + tail) & (x["value"] < F.col("level"))), lambda x: x["t"])))
    out = out.withColumn("payoff_ts", F.greatest(F.col("main_end"), F.least(F.coalesce(F.greatest("burst_end", "decay"), at), at + tail)))
    out = out.withColumn("natural_end", F.array_min(F.filter(F.transform("quiet", lambda x: x["start"]), lambda x: x >= F.col("payoff_ts"))))
    hook = (
        F.when(F.col("main.previous").isNotNull(), F.greatest(at - cfg.hook_lookback, F.least(F.col("main.previous"), at - cfg.min_context)))
        .when(F.size("said") == 0, at - max(0.0, max(cfg.min_seconds, cfg.target_seconds) - tail))
        .otherwise(at - cfg.hook_lookback)
    )
    out = out.withColumns({"hook_ts": F.greatest(F.col("floor"), F.least(hook, at)), "stop_ts": F.coalesce("natural_end", "payoff_ts")})
    out = out.withColumns({"start": F.greatest("floor", _snapped(F.col("hook_ts"), F.col("words"), F.col("quiet"), "start", cfg.start_tolerance, "start")), "end": _snapped(F.col("stop_ts"), F.col("words"), F.col("quiet"), "end", cfg.end_tolerance, "end")})
    window = review_window(constrain(out, cfg).withColumnsRenamed({c: f"own_{c}" for c in ("start", "end", "main_ts", "hook_ts", "payoff_ts")}), cfg)
    usable = F.col("evidence") & (F.col("own_end") > F.col("own_start"))
    inside = lambda c: F.least(F.greatest(F.col(c), F.col("own_start")), F.col("own_end"))
    pick = lambda own, name: F.when(usable, own).otherwise(F.col(name)).alias(name)
    return window.select(
        "candidate_id", pick(F.col("own_start"), "start"), pick(F.col("own_end"), "end"), pick(F.col("own_main_ts"), "main_ts"), pick(inside("own_hook_ts"), "hook_ts"), pick(inside("own_payoff_ts"), "payoff_ts"),
        F.when(usable, "signal_evidence").otherwise("review_window").alias("method"), "main_end", "burst_end", "decay", "natural_end", F.when(usable, F.col("rules")).otherwise(none.cast("array<string>")).alias("rules"),
    )


def apply_proposal(decided: DataFrame, proposals: DataFrame, cfg: Bounds = Bounds()) -> DataFrame:
    """A proposed (candidate_id, start, end, main_ts, payoff_ts), held within the rules; missing values keep the decided ones."""
    p = proposals.select("candidate_id", *(F.col(c).try_cast("double").alias(f"p_{c}") for c in ("start", "end", "main_ts", "payoff_ts")))
    out = decided.join(p, KEY, "left")
    for c in ("main_ts", "payoff_ts", "start", "end"):
        out = out.withColumn(c, F.coalesce(f"p_{c}", c))
    return constrain(out, cfg).drop(*(f"p_{c}" for c in ("start", "end", "main_ts", "payoff_ts")))


def fix_moment(moment: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(moment, low), high)
