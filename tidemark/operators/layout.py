"""Composition plans: which layers show what, and where captions go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Layout
from tidemark.functions import geometry as g
from tidemark.operators.track import crop_center, steady_spans

# Fixed values of the layouts.
PANEL_GAP = 8
GAMEPLAY_RATIO = 0.6
FACECAM_MIN_WIDTH = 0.22
CAPTION_LINE_HEIGHT = 1.25
SUBJECT_HEIGHT = 0.25

#: Caption sizes by which bands are planned.
STYLES = {"karaoke_highlight": 78.0, "block_pop": 84.0, "minimal": 60.0}
#: Caption styles: font, size, weight, capitals, karaoke, outline, shadow, pop (fixed values).
CAPTIONS = {
    "karaoke_highlight": ("Arial", 54, 1, True, True, 4, 2, 0),
    "block_pop": ("Arial", 60, 1, True, False, 5, 3, 108),
    "minimal": ("Arial", 44, 0, False, False, 3, 1, 0),
}
#: Alignments of subtitles by anchor (fixed values).
ANCHORS = {"bottom": 2, "middle": 5, "top": 8}


def resolve_style(name: Column, font: Column | None = None, size: Column | None = None, capitals: bool = True) -> Column:
    """Struct of the named caption style (unknown names: ``karaoke_highlight``); a font or size given beats its own, capitals can be refused."""
    known = F.when(name.isin(*CAPTIONS), name).otherwise(F.lit(next(iter(CAPTIONS))))
    field = lambda k: F.coalesce(*(F.when(known == style, F.lit(values[k])) for style, values in CAPTIONS.items()))
    given = lambda own, k, nothing: field(k) if own is None else F.coalesce(F.nullif(own, F.lit(nothing)), field(k))
    return F.struct(
        known.alias("name"), given(font, 0, "").alias("font"), given(size, 1, 0).alias("size"), field(2).alias("bold"), (field(3) & F.lit(capitals)).alias("capitals"),
        field(4).alias("karaoke"), field(5).alias("outline"), field(6).alias("shadow"), field(7).alias("pop"),
    )


def resolve_anchor(safe_area: Column, prefer_top: Column) -> Column:
    """Struct of anchor and alignment: a named band is taken as it is, anything else is the bottom, or the top where the subject is at the bottom."""
    anchor = F.when(safe_area.isin(*ANCHORS), safe_area).when(F.coalesce(prefer_top, F.lit(False)), "top").otherwise("bottom")
    return F.struct(anchor.alias("anchor"), F.coalesce(*(F.when(anchor == a, F.lit(n)) for a, n in ANCHORS.items())).alias("alignment"))


def resolve_strategy(requested: Column, width: Column, height: Column, has_facecam: Column, cfg: Layout = Layout()) -> Column:
    """Struct of strategy and warnings: a crop is only chosen where the source is tall enough."""
    auto = requested == "auto"
    first = F.when(~auto, requested).when(has_facecam, "gaming").when(F.least(width, height) >= cfg.min_tracked_height, "irl").otherwise("fit_blur")
    crops = first.isin("irl", "conversation")
    low = (auto & ~has_facecam & (F.least(width, height) < cfg.min_tracked_height)) | (crops & (height < cfg.min_tracked_height))
    final = F.when(crops & (height < cfg.min_tracked_height), "fit_blur").otherwise(first)
    untracked = final.isin("irl", "conversation") & F.lit(cfg.track_backend == "none")
    return F.struct(final.alias("strategy"), F.array_compact(F.array(F.when(low, "low_resolution_layout"), F.when(untracked, "tracking_unavailable"))).alias("warnings"))


def facecam_from_track(track: DataFrame, clips: DataFrame, cfg: Layout = Layout(), min_hits: int = 4, aspect: float | None = None) -> DataFrame:
    """A tile around the median face of each clip, as fractions of its frame; (clip_id, box), clips with too few faces left out."""
    seen = track.filter((F.col("width") > 0) & (F.col("height") > 0)).groupBy("clip_id").agg(F.count("*").alias("n"), *(F.median(c).alias(f"m_{c}") for c in ("x", "y", "width", "height")))
    j = seen.filter(F.col("n") >= max(1, min_hits)).join(clips.select("clip_id", F.col("source_width").cast("double").alias("sw"), F.col("source_height").cast("double").alias("sh")), "clip_id").filter("sw > 0 and sh > 0")
    pad = max(1.0, cfg.facecam_pad)
    sw, sh = F.col("sw"), F.col("sh")
    fw, fh = F.col("m_width") * pad * sw, F.col("m_height") * pad * sh
    w = F.least(sw, F.greatest(fw, FACECAM_MIN_WIDTH * sw))
    if aspect and aspect > 0:
        h = F.greatest(w / aspect, fh)
        w = F.when(w / aspect < fh, h * aspect).otherwise(w)
    else:
        h = w
    w, h = F.least(w, sw), F.least(h, sh)
    tile = g.placed(g.frame(sw, sh), w, h, F.col("m_x"), F.col("m_y"))
    return j.select("clip_id", g.box(tile["x"] / sw, tile["y"] / sh, tile["w"] / sw, tile["h"] / sh).alias("box"))


def panel_aspect(cfg: Layout = Layout()) -> float:
    return cfg.canvas_width / max(1.0, cfg.canvas_height - round(cfg.canvas_height * GAMEPLAY_RATIO))


def _layer(kind: str, src: Column, dst: Column, z: int) -> Column:
    return F.struct(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), F.lit(z).alias("z"))


def with_layers(segments: DataFrame, cfg: Layout = Layout()) -> DataFrame:
    """Segments (strategy, source_width, source_height, crop_x, crop_y, cam box in pixels or null) with their ``layers`` (kind, src, dst, z).

    Boxes are columns of their own: expressions that hold one another several
    times over take longer to compile than to run.
    """
    w, h = float(cfg.canvas_width), float(cfg.canvas_height)
    n = lambda v: F.lit(float(v))
    canvas, game_h, half = g.box(n(0), n(0), n(w), n(h)), float(round(h * GAMEPLAY_RATIO)), (h - PANEL_GAP) / 2
    width, height, ratio = F.col("source_width").cast("double"), F.col("source_height").cast("double"), F.col("_ratio")
    out = segments.withColumns({"_whole": g.frame(width, height), "_ratio": F.coalesce(F.try_divide(width, F.when(height > 0, height)), n(w / h)), "_left": g.box(n(0), n(0), width / 2, height), "_right": g.box(width / 2, n(0), width / 2, height)})
    out = out.withColumns({"_fit": F.least(n(w), h * ratio), "_cover": F.greatest(n(w), h * ratio)})
    out = g.cropped(out, "_whole", w / h, "_crop", F.col("crop_x"), F.col("crop_y"))
    if cfg.zoom > 1.0:
        out = out.withColumn("_crop", g.tighten(F.col("_crop"), F.col("_whole"), cfg.zoom, F.col("crop_x"), F.col("crop_y")))
    for source, shape, name in (("_whole", w / game_h, "_game"), ("cam", w / (h - game_h), "_cam"), ("_left", w / half, "_one"), ("_right", w / half, "_other")):
        out = g.cropped(out, source, shape, name)
    col, strategy = F.col, F.col("strategy")
    centred = lambda x: g.box((n(w) - x) / 2, (n(h) - x / ratio) / 2, x, x / ratio)
    fit = F.array(_layer("blur", col("_whole"), centred(col("_cover")), 0), _layer("video", col("_whole"), centred(col("_fit")), 1))
    irl = F.array(_layer("video", col("_crop"), canvas, 1))
    game, cam = _layer("video", col("_game"), g.box(n(0), n(0), n(w), n(game_h)), 1), _layer("panel", col("_cam"), g.box(n(0), n(game_h), n(w), n(h - game_h)), 2)
    talk = F.array(_layer("panel", col("_one"), g.box(n(0), n(0), n(w), n(half)), 1), _layer("panel", col("_other"), g.box(n(0), n(half + PANEL_GAP), n(w), n(half)), 2))
    chosen = F.when(strategy == "irl", irl).when(strategy == "gaming", F.when(col("cam").isNotNull(), F.array(game, cam)).otherwise(F.array(game))).when(strategy == "conversation", talk).otherwise(fit)
    return out.withColumn("layers", chosen).drop("_whole", "_ratio", "_left", "_right", "_fit", "_cover", "_crop", "_game", "_cam", "_one", "_other")


def caption_bands(font: float, cfg: Layout = Layout()) -> dict[str, tuple[float, float]]:
    """Vertical strips that captions take at the bottom and at the top."""
    band, h, m = font * CAPTION_LINE_HEIGHT * cfg.caption_lines, float(cfg.canvas_height), cfg.caption_margin
    return {"bottom": (max(0.0, h - m - band), max(0.0, h - m)), "top": (m, min(h, m + band))}


def band_coverage(track: DataFrame, segments: DataFrame, clips: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Share of a clip's track points whose subject, drawn through its layer, meets each band; 0 without evidence.

    Points meet the first segment of their clip with start <= t < end; a clip has
    few segments (``max_segments``), so they are joined by clip alone.
    """
    spans = segments.filter("end > start").select("clip_id", "start", "end", "layers")
    points = track.select("clip_id", "seq", "t", "y", "height")
    hit = points.join(spans, "clip_id").filter((F.col("start") <= F.col("t")) & (F.col("t") < F.col("end")))
    first = hit.groupBy("clip_id", "seq", "t", "y", "height").agg(F.min_by("layers", "start").alias("layers")).join(clips.select("clip_id", F.col("source_height").cast("double").alias("sh")), "clip_id").filter("sh > 0")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * F.col("sh")
    half = F.when(F.col("height") > 0, F.greatest(F.lit(0.01), F.col("height")) / 2).otherwise(SUBJECT_HEIGHT / 2)
    points = first.select("clip_id", "layers", unit(F.col("y")).alias("at"), unit(F.col("y") - half).alias("top"), unit(F.col("y") + half).alias("low"))

    def meets(band: tuple[float, float]) -> Column:
        a, b = band
        if b <= a:
            return F.lit(False)

        def drawn(layer: Column) -> Column:
            src, dst = layer["src"], layer["dst"]
            scale = F.try_divide(dst["h"], F.when(src["h"] > 0, src["h"]))
            holds = (layer["kind"] != "blur") & (src["h"] > 0) & (src["y"] <= F.col("at")) & (F.col("at") <= src["y"] + src["h"])
            return F.coalesce(holds & (dst["y"] + (F.col("top") - src["y"]) * scale <= b) & (dst["y"] + (F.col("low") - src["y"]) * scale >= a), F.lit(False))

        return F.exists("layers", drawn)

    shares = points.groupBy("clip_id").agg(*(F.avg(meets(band).cast("double")).alias(name) for name, band in bands.items()))
    return clips.select("clip_id").join(shares, "clip_id", "left").fillna(0.0, list(bands))


def plan(clips: DataFrame, track: DataFrame, cfg: Layout = Layout(), font: float = STYLES["karaoke_highlight"], crop_bias: float = 0.0, derived: DataFrame | None = None) -> dict[str, DataFrame]:
    """Plans of clips (clip_id, requested, source_width, source_height, duration, facecam box or null).

    Clips that have no box but ask for one (``facecam_auto``) get theirs from
    ``derived`` (clip_id, box) or, where that is not given, from the track.
    ``segments``: (clip_id, start, end, crop_x, layers).  ``plans``: strategy,
    upscale factor, caption band, where the facecam box came from and warnings.
    """
    asks = F.col("facecam").isNull() & F.coalesce("facecam_auto", F.lit(False)) if "facecam_auto" in clips.columns else F.lit(False)
    c = clips.withColumn("asks", asks)
    if "facecam_auto" in clips.columns:
        found = facecam_from_track(track, clips, cfg, aspect=panel_aspect(cfg)) if derived is None else derived
        c = c.join(found.select("clip_id", F.col("box").alias("found")), "clip_id", "left").withColumn("facecam", F.coalesce("facecam", F.when(F.col("asks"), F.col("found")))).drop("found")
    c = c.withColumn("cam", g.facecam(F.col("facecam"), F.col("source_width").cast("double"), F.col("source_height").cast("double")))
    c = c.withColumn("r", resolve_strategy(F.col("requested"), F.col("source_width"), F.col("source_height"), F.col("cam").isNotNull(), cfg))
    missing = (F.col("r.strategy") == "gaming") & F.col("cam").isNull()
    c = c.withColumn("strategy", F.when(missing, "fit_blur").otherwise(F.col("r.strategy"))).withColumn("warnings", F.concat("r.warnings", F.array_compact(F.array(F.when(missing, "facecam_box_missing"), F.when(F.col("asks") & F.col("cam").isNull(), "facecam_box_auto_failed"), F.when(F.col("asks") & F.col("cam").isNotNull() & (F.col("r.strategy") == "gaming"), "facecam_box_auto")))))
    c = c.withColumn("facecam_source", F.when((F.col("strategy") == "gaming") & F.col("cam").isNotNull(), F.when(F.col("asks"), "auto").otherwise("config")).otherwise(""))
    whole = g.crop_inside(g.frame(F.col("source_width"), F.col("source_height")), F.lit(cfg.canvas_width / cfg.canvas_height))
    irl = c.filter("strategy = 'irl'").withColumn("crop_height", whole["h"])
    tracked = track.join(irl.select("clip_id", "duration", F.col("source_height").cast("double").alias("source_height"), "crop_height"), "clip_id")
    spans = steady_spans(tracked, ["clip_id"], cfg=cfg)
    still = irl.join(spans.select("clip_id").distinct(), "clip_id", "left_anti").select("clip_id", F.lit(0.0).alias("start"), F.col("duration").cast("double").alias("end"), F.lit(0.5).alias("x"))
    cut = spans.unionByName(still).join(crop_center(tracked, ["clip_id"]), "clip_id", "left")
    moving = cut.select("clip_id", "start", "end", g.clamp(F.col("x") + crop_bias, F.lit(0.0), F.lit(1.0)).alias("crop_x"), F.coalesce("crop_y", F.lit(0.5)).alias("crop_y"))
    fixed = c.filter("strategy <> 'irl'").select("clip_id", F.lit(0.0).alias("start"), F.greatest(F.lit(0.0), F.col("duration").cast("double")).alias("end"), F.lit(0.5).alias("crop_x"), F.lit(0.5).alias("crop_y"))
    segments = moving.unionByName(fixed).join(c.select("clip_id", "strategy", "source_width", "source_height", "cam"), "clip_id")
    segments = with_layers(segments, cfg).select("clip_id", "start", "end", "crop_x", "layers")
    grown = segments.select("clip_id", F.explode("layers").alias("l")).filter("l.kind <> 'blur'").groupBy("clip_id").agg(F.greatest(F.lit(1.0), F.max(g.upscale(F.col("l.src"), F.col("l.dst")))).alias("factor"))
    shares = band_coverage(track, segments, clips, caption_bands(font, cfg))
    p = c.join(grown, "clip_id", "left").join(shares, "clip_id", "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    busy = (F.col("strategy") != "gaming") & (F.col("bottom") > cfg.avoid_ratio) & (F.col("bottom") >= F.col("top"))
    warnings = F.concat("warnings", F.array_compact(F.array(F.when(F.col("factor") > cfg.warn_upscale, "upscale_exceeds_threshold"), F.when(busy, "caption_band_moved"))))
    plans = p.select("clip_id", F.col("requested"), "strategy", F.round("factor", 3).alias("upscale_factor"), ((F.col("strategy") == "gaming") | busy).alias("caption_prefer_top"), F.round("bottom", 4).alias("bottom_coverage"), "facecam_source", warnings.alias("warnings"))
    return {"segments": segments, "plans": plans}
