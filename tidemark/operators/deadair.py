"""Which silences of a clip to cut, within a budget: a sweep over the ends of spans.

Silences, words and protected parts give two rows each, where they begin and
where they end.  Running sums over a clip's rows, by time, tell what covers the
stretch up to the next row; stretches that are silent and nothing else are what
may be cut.  Every step is a sort and a running sum, so time grows with n log n
and no array of spans is built, however many a clip has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DeadAir
from tidemark.operators import spans

KEY = ["clip_id"]
#: Kinds of coverage.
SILENT, SPOKEN, GUARDED = "silent", "spoken", "guarded"


def _real(rows: DataFrame) -> DataFrame:
    return rows.select("clip_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")).filter(F.col("end") > F.col("start"))


def stretches(covers: dict[str, DataFrame]) -> DataFrame:
    """(clip_id, start, end, and a count per kind): what covers each stretch between neighbouring ends of spans."""
    ends = None
    for kind, rows in covers.items():
        deltas = [F.lit(1 if k == kind else 0).alias(k) for k in covers]
        both = _real(rows).select("clip_id", F.explode(F.array(F.struct(F.col("start").alias("at"), *deltas), F.struct(F.col("end").alias("at"), *(F.lit(-1 if k == kind else 0).alias(k) for k in covers)))).alias("x")).select("clip_id", "x.*")
        ends = both if ends is None else ends.unionByName(both)
    at = Window.partitionBy("clip_id").orderBy("at")
    changes = ends.groupBy("clip_id", "at").agg(*(F.sum(k).alias(k) for k in covers))
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    found = changes.select("clip_id", F.col("at").alias("start"), F.lead("at").over(at).alias("end"), *(F.sum(k).over(upto).alias(k) for k in covers))
    return found.filter(F.col("end").isNotNull())


def _judged(clips: DataFrame, silences: DataFrame, cfg: DeadAir, words: DataFrame | None, protect: DataFrame | None) -> DataFrame:
    """Silent stretches with what was decided: (clip_id, duration, start, end, free, open, long, cut, from), ``from`` being where the cut before one ends.

    Those that may be cut are shrunk by the pad already.
    """
    none = clips.select("clip_id", F.lit(0.0).alias("start"), F.lit(0.0).alias("end")).limit(0)
    lengths = clips.select("clip_id", F.col("duration").cast("double").alias("duration")).filter((F.col("duration") > 0) & F.lit(cfg.enabled))
    inside = _real(silences).join(lengths, "clip_id").select("clip_id", F.greatest("start", F.lit(0.0)).alias("start"), F.least("end", "duration").alias("end"))
    heard = spans.merge(inside, KEY, cfg.keep_pad)
    found = stretches({SILENT: heard, SPOKEN: none if words is None else words, GUARDED: none if protect is None else protect}).filter(F.col(SILENT) > 0)
    free = F.col(SPOKEN) == 0
    found = found.withColumns({"free": free, "open": free & (F.col(GUARDED) == 0)}).drop(SILENT, SPOKEN, GUARDED)
    for name, by in (("start", cfg.keep_pad), ("end", -cfg.keep_pad)):
        found = found.withColumn(name, F.when(F.col("open"), F.col(name) + by).otherwise(F.col(name)))
    long = F.col("open") & (F.col("end") > F.col("start")) & (F.col("end") - F.col("start") >= cfg.min_gap)
    found = found.withColumn("long", long).join(lengths, "clip_id")
    # Drops come off the top, so what stays is the run from the shortest on whose sum is within the budget; of equals the earliest is dropped.
    length = F.col("end") - F.col("start")
    shortest = Window.partitionBy("clip_id").orderBy(F.col("long").desc(), F.round(length, 3), F.col("start").desc()).rowsBetween(Window.unboundedPreceding, 0)
    within = F.sum(F.when(F.col("long"), length)).over(shortest) <= F.col("duration") * cfg.max_removed_ratio + 1e-9
    found = found.withColumn("cut", F.col("long") & within)
    earlier = Window.partitionBy("clip_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("from", F.coalesce(F.max(F.when(F.col("cut"), F.col("end"))).over(earlier), F.lit(0.0)))


def _between(clips: DataFrame, judged: DataFrame) -> DataFrame:
    """(clip_id, start, end): what the cuts leave of each clip, head and tail included."""
    cuts = judged.filter("cut")
    heads = cuts.select("clip_id", F.col("from").alias("start"), F.col("start").alias("end"))
    last = cuts.groupBy("clip_id").agg(F.max("end").alias("last"))
    tails = clips.select("clip_id", F.col("duration").cast("double").alias("end")).join(last, "clip_id", "left").select("clip_id", F.coalesce("last", F.lit(0.0)).alias("start"), "end")
    return heads.unionByName(tails).filter(F.col("end") > F.col("start"))


def plan(clips: DataFrame, silences: DataFrame, cfg: DeadAir = DeadAir(), words: DataFrame | None = None, protect: DataFrame | None = None) -> dict[str, DataFrame]:
    """Cuts of clips (clip_id, duration): ``gaps`` to remove, ``keeps`` to show and a ``summary`` per clip.

    Silences, words and protected parts are rows (clip_id, start, end) in
    seconds; those without an end or a start count for nothing.  The summary has
    mode, applied, removed_seconds and a reason where nothing is cut.  ``rest`` is
    what lies between the gaps.
    """
    judged = _judged(clips, silences, cfg, words, protect)
    counted: dict[str, Column] = {f"n_{k}": F.count_if(F.col(k)) for k in ("free", "open", "long", "cut")}
    cut_length = F.sum(F.when(F.col("cut"), F.col("end") - F.col("start")))
    head = F.col("cut") & (F.col("start") > F.col("from")) & (F.col("start") - F.col("from") >= cfg.min_keep)
    per = judged.groupBy("clip_id").agg(
        F.count("*").alias("n_heard"), *(c.alias(k) for k, c in counted.items()), cut_length.alias("cut_length"), F.max(F.when(F.col("cut"), F.col("end"))).alias("last"),
        F.count_if(head).alias("heads"), F.sum(F.when(head, F.col("start") - F.col("from"))).alias("head_length"),
    )
    out = clips.select("clip_id", F.col("duration").cast("double").alias("duration")).join(per, "clip_id", "left")
    out = out.fillna(0, [*counted, "n_heard", "heads"]).fillna(0.0, ["cut_length", "head_length", "last"])
    if cfg.mode == "speed":
        out = out.withColumns({"n_shown": F.lit(1), "removed": F.col("cut_length") * (1.0 - 1.0 / max(1.0, cfg.speed_factor))})
    else:
        tail = F.col("duration") - F.col("last")
        shown = (tail > 0) & (tail >= cfg.min_keep)
        out = out.withColumns({"n_shown": F.col("heads") + shown.cast("int"), "removed": F.greatest(F.lit(0.0), F.col("duration") - (F.col("head_length") + F.when(shown, tail).otherwise(0.0)))})
    out = out.withColumn("applied", (F.col("n_cut") > 0) & (F.col("n_shown") > 0))
    reason = (
        F.when(F.lit(not cfg.enabled), "dead-air removal disabled")
        .when(F.col("duration") <= 0, "clip has no duration")
        .when(F.col("n_heard") == 0, "no silence detected: nothing worth cutting")
        .when(F.col("n_free") == 0, "every silent gap contained speech, so nothing was cut")
        .when(F.col("n_open") == 0, "the only silence was inside the payoff region")
        .when(F.col("n_long") == 0, "every silent gap was too short to be worth cutting")
        .when(F.col("n_cut") == 0, "the cap left nothing cuttable")
        .when(F.col("n_shown") == 0, "cutting would have removed the whole clip")
    )
    summary = out.select("clip_id", "duration", F.lit(cfg.mode).alias("mode"), "applied", F.when(F.col("applied"), F.col("removed")).otherwise(0.0).alias("removed_seconds"), (F.col("n_cut") < F.col("n_long")).alias("capped"), F.col("n_cut").cast("long").alias("n_gaps"), reason.alias("reason"))
    rest = _between(clips, judged)
    whole = summary.filter(F.lit(cfg.mode == "speed") | ~F.col("applied")).select("clip_id", F.lit(0.0).alias("start"), F.col("duration").alias("end"))
    shown = rest.filter(F.lit(cfg.mode != "speed") & (F.col("end") - F.col("start") >= cfg.min_keep)).join(summary.filter("applied").select("clip_id"), "clip_id", "left_semi")
    return {"gaps": judged.filter("cut").select("clip_id", "start", "end"), "keeps": shown.unionByName(whole), "summary": summary, "rest": rest}


def render_segments(planned: dict[str, DataFrame], cfg: DeadAir = DeadAir()) -> DataFrame:
    """(clip_id, start, end, speed): kept parts at 1, or all parts with gaps at the speed factor."""
    if cfg.mode != "speed":
        return planned["keeps"].select("clip_id", "start", "end", F.lit(1.0).alias("speed"))
    return planned["rest"].withColumn("speed", F.lit(1.0)).unionByName(planned["gaps"].withColumn("speed", F.lit(max(1.0, cfg.speed_factor))))
