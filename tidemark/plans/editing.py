"""Edit plans: bounds, dead air and layout of chosen candidates, assembled as documents."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators import bounds, store
from tidemark.sources.documents import to_documents


def build_plans(candidates: DataFrame, words: DataFrame, chat: DataFrame, levels: DataFrame, overrides: DataFrame | None = None, cfg: Settings = Settings(), limit: int = 20) -> DataFrame:
    """Plans of the best candidates (candidate_id, source_ts, pre, post, score); overrides (candidate_id, strategy, style) beat settings."""
    jobs = store.top_jobs(candidates, limit, id_col="candidate_id")
    decided = bounds.decide(jobs, words, chat, levels, cfg.bounds, cfg.chat)
    out = decided.join(jobs.select("candidate_id", "score"), "candidate_id")
    if overrides is not None:
        out = out.join(overrides.select("candidate_id", "strategy", "style"), "candidate_id", "left")
    else:
        out = out.withColumns({"strategy": F.lit(None).cast("string"), "style": F.lit(None).cast("string")})
    strategy = F.coalesce(F.nullif("strategy", F.lit("auto")), F.when(F.lit(cfg.layout.strategy != "auto"), F.lit(cfg.layout.strategy)), F.lit(""))
    out = out.withColumns({"strategy": strategy, "style": F.coalesce("style", F.lit("karaoke_highlight")), "duration": F.col("end") - F.col("start")})
    return out.withColumn("document", to_documents(out))


def quality_warnings(width: Column, height: Column, factor: Column, most: float = 2.0) -> Column:
    """Codes, each once: unknown size, more enlargement than ``most``."""
    unknown = F.coalesce(width, F.lit(0)) * F.coalesce(height, F.lit(0)) <= 0
    return F.array_compact(F.array(F.when(unknown, "unknown_source_size"), F.when(~unknown & (factor > most), "upscale_exceeds_threshold")))


def plan_upscale(width: Column, height: Column, strategy: Column, zoom: float = 1.0, canvas: tuple[int, int] = (1080, 1920)) -> Column:
    """Enlargement a plan implies: the fitting axis for a fitted frame, the larger for a crop, times the zoom; 1 for unknown sizes."""
    sx, sy = F.try_divide(F.lit(float(canvas[0])), width.cast("double")), F.try_divide(F.lit(float(canvas[1])), height.cast("double"))
    scale = F.when(strategy == "fit_blur", F.least(sx, sy)).otherwise(F.greatest(sx, sy) * max(1.0, zoom))
    return F.when((width > 0) & (height > 0), F.greatest(F.lit(1.0), scale)).otherwise(1.0)


def reuse_bounds(jobs: DataFrame, earlier: DataFrame) -> DataFrame:
    """Jobs (candidate_id, source_path) with the bounds of an earlier plan of the same source, null otherwise."""
    return jobs.join(earlier.select("candidate_id", "source_path", "start", "end"), ["candidate_id", "source_path"], "left")


def source_range(plans: DataFrame, offset: str = "source_offset") -> DataFrame:
    """Bounds on the media's clock: the source offset is added to both ends, never below zero."""
    shift = F.coalesce(offset, F.lit(0.0))
    return plans.withColumns({"media_start": F.greatest(F.lit(0.0), F.col("start") + shift), "media_end": F.greatest(F.lit(0.0), F.col("end") + shift)})


def cut_list(plans: DataFrame, segments: DataFrame) -> DataFrame:
    """What a renderer has to cut: (candidate_id, place, from, to, speed) on the media's clock."""
    return source_range(plans).join(segments, "candidate_id").select("candidate_id", F.col("place"), (F.col("media_start") + F.col("seg_start")).alias("from"), (F.col("media_start") + F.col("seg_end")).alias("to"), "speed")


def call_service(rows: DataFrame, key: str, request: str, service: Callable[[str], str | None], limit: int | None = None) -> DataFrame:
    """Answers of an outside service per row (key, answer, error); a failure is that row's alone.

    Limit and write ``rows`` first, so that a retried task asks again only for its own rows.
    """
    chosen = rows.select(key, request)
    chosen = chosen if limit is None else chosen.limit(max(0, limit))

    def run(batches):
        for frame in batches:
            answers, errors = [], []
            for text in frame[request]:
                try:
                    answers.append(service(text))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  the row's own failure is its result
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pd.DataFrame({key: frame[key], "answer": pd.Series(answers, dtype="object"), "error": pd.Series(errors, dtype="object")})

    return chosen.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, answer string, error string")
