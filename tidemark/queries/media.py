"""Queries of alignment, bounds, tracks and layouts over events, embeddings and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Bounds, ChatRates, Settings
from tidemark.functions.times import MICROS
from tidemark.operators import alignment, bounds, layout, track
from tidemark.plans import editing
from tidemark.queries.common import EVENTS, events, rounded, table

START = 1704067200 * MICROS


def _seconds(df: DataFrame) -> DataFrame:
    return df.withColumn("t", (F.col("us") - START) / float(MICROS))


def timeline_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag in hours at which a user's other events follow the clicks best."""
    e = _seconds(events(spark, sf_dir))
    got = alignment.timeline_offset(e.filter("event_type = 'click'"), e.filter("event_type <> 'click'"), ["user_id"], 3600.0, 720, 24)
    return got.select("user_id", "lag", F.round("score", 6).alias("score"), "active_first", "active_second")


def sliding_ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second quarter of each vector found again within the whole."""
    v = table(spark, sf_dir, "embeddings")
    n = F.size("embedding")
    pairs = v.select(F.col("vec_id").alias("clip_id"), F.col("embedding").cast("array<double>").alias("wide"), F.slice(F.col("embedding").cast("array<double>"), (n / 4 + 1).cast("int"), (n / 4).cast("int")).alias("clip"), F.lit(0.0).alias("wide_start"), F.lit(0.0).alias("clip_start"))
    return alignment.clip_offsets(pairs).select("clip_id", "lag", F.round("score", 4).alias("score"))


def verified_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as scores of clips of a user, hours as offsets."""
    e = _seconds(events(spark, sf_dir)).select("user_id", (F.col("value") / 100).alias("score"), (F.col("t") / 3600).alias("offset"))
    got = alignment.verified_offset(e, ["user_id"])
    return got.select("user_id", F.round("offset", 5).alias("offset"), F.round("score", 6).alias("score"), "checked", "confident", "is_confident")


def baseline_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    days = e.groupBy(F.floor(F.col("us") / (86_400 * MICROS)).alias("day")).agg(F.collect_list("value").alias("values"))
    return days.select("day", F.round(bounds.median_of(F.col("values")), 6).alias("median"))


def _moments(e: DataFrame) -> DataFrame:
    """The best event of each user as a candidate."""
    best = e.groupBy("user_id").agg(F.max_by("t", F.struct("value", -F.col("t"))).alias("source_ts"), F.max("value").alias("score"))
    return best.select(F.col("user_id").alias("candidate_id"), "source_ts", F.lit(3600.0).alias("pre"), F.lit(7200.0).alias("post"), "score")


def burst_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long a user's events keep coming after the best one, at one in two hours and more."""
    e = _seconds(events(spark, sf_dir))
    own = e.select(F.col("user_id").alias("candidate_id"), "t")
    return bounds.burst_end(_moments(e), own, ChatRates(window=7200.0, min_rate=1 / 7200), 36_000.0).select("candidate_id", rounded(F.col("burst_end"), 3).alias("burst_end"))


def level_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _seconds(events(spark, sf_dir))
    levels = e.select(F.col("user_id").alias("candidate_id"), "t", "value")
    return bounds.level_decay(_moments(e), levels, 864_000.0, 0.02, 864_000.0).select("candidate_id", F.round("decay", 3).alias("decay"))


#: Bounds and rates of events that are minutes apart.
WIDE = Settings(
    bounds=Bounds(min_seconds=600.0, max_seconds=5400.0, target_seconds=1800.0, hook_lookback=3600.0, reaction_tail=1800.0, min_context=300.0, start_tolerance=600.0, end_tolerance=900.0, utterance_gap=60.0),
    chat=ChatRates(window=600.0, min_rate=1 / 300),
)


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Each user's best event as a candidate, with that user's events as words, chat and levels."""
    e = _seconds(events(spark, sf_dir))
    own = F.col("user_id").alias("candidate_id")
    words = e.select(own, F.col("t").alias("start"), (F.col("t") + F.col("value") * 10).alias("end"), F.col("event_type").alias("text"))
    return _moments(e), words, e.select(own, "t"), e.select(own, "t", "value")


def bounds_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bounds.decide(*_evidence(spark, sf_dir), WIDE.bounds, WIDE.chat)
    return got.select("candidate_id", *(F.round(c, 3).alias(c) for c in ("start", "end", "main_ts", "hook_ts", "payoff_ts")), "method", F.array_join("rules", "; ").alias("rules"))


def review_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _seconds(events(spark, sf_dir))
    m = e.select(F.col("seq").alias("candidate_id"), F.col("t").alias("source_ts"), (F.col("value") / 2).alias("pre"), F.col("value").alias("post"))
    got = bounds.review_window(m)
    return got.select("candidate_id", *(F.round(c, 6).alias(c) for c in ("start", "end", "main_ts", "hook_ts", "payoff_ts")))


def edit_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of the twenty best candidates from all their evidence; some ask for a strategy or style of their own."""
    moments, *evidence = _evidence(spark, sf_dir)
    third = F.col("candidate_id") % 3
    asked = moments.select("candidate_id", F.when(third == 0, "irl").when(third == 1, "auto").alias("strategy"), F.when(third == 0, "minimal").alias("style"))
    return editing.build_plans(moments, *evidence, overrides=asked, cfg=WIDE).select("candidate_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "strategy", "style")


def proposed_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detection windows, with starts and ends proposed by a service held within the rules."""
    e = _seconds(events(spark, sf_dir))
    m = e.select(F.col("seq").alias("candidate_id"), F.col("t").alias("source_ts"), (F.col("value") / 2).alias("pre"), F.col("value").alias("post"))
    held = bounds.review_window(m).withColumns({"floor": F.greatest(F.lit(0.0), F.col("source_ts") - 60), "ceiling": F.col("source_ts") + 90})
    odd = F.col("candidate_id") % 3
    asked = m.select("candidate_id", F.when(odd > 0, F.col("source_ts") - F.col("post") / 4 + 5).cast("string").alias("start"), F.when(odd > 1, F.col("source_ts") + F.col("post")).otherwise(None).cast("string").alias("end"), F.lit("soon").alias("main_ts"), F.lit(None).cast("string").alias("payoff_ts"))
    got = bounds.apply_proposal(held, asked)
    return got.select("candidate_id", *(F.round(c, 6).alias(c) for c in ("start", "end", "main_ts", "payoff_ts")), F.array_join("rules", "; ").alias("rules"))


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a user as a track across the picture: x of 200, y by the hour."""
    e = _seconds(events(spark, sf_dir))
    return e.select(F.col("user_id").alias("clip_id"), "seq", "t", (F.col("value") % 100 / 100).alias("x"), (F.col("t") % 86400 / 86400).alias("y"), F.lit(0.0).alias("width"), F.when(F.col("event_type") == "view", 0.2).otherwise(0.0).alias("height"), F.lit(30 * 86400.0).alias("duration"))


def deadband_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.config import Layout

    got = track.steady_spans(_track(spark, sf_dir), ["clip_id"], cfg=Layout(deadband=0.3, max_segments=1_000_000))
    return got.select("clip_id", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), F.round("x", 6).alias("x"))


def capped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = track.steady_spans(_track(spark, sf_dir), ["clip_id"])
    return got.select("clip_id", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), F.round("x", 6).alias("x"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Center of a user's activity over the hours of the day."""
    e = _seconds(events(spark, sf_dir))
    hours = e.groupBy("user_id", F.floor(F.col("t") % 86400 / 3600).alias("place")).agg(F.sum("value").alias("energy"))
    spine = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("place"))
    full = spine.join(hours, ["user_id", "place"], "left").fillna(0.0, ["energy"])
    return track.centroid(full, ["user_id"]).select("user_id", F.round("center", 6).alias("center"))


def crop_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _track(spark, sf_dir).withColumns({"source_height": F.lit(1080.0), "crop_height": F.lit(540.0)})
    return track.crop_center(t, ["clip_id"]).select("clip_id", F.round("crop_y", 6).alias("crop_y"))


def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of track points drawn within each caption band of a plain crop."""
    from tidemark.functions import geometry as g

    t = _track(spark, sf_dir)
    clips = t.select("clip_id").distinct().withColumn("source_height", F.lit(1080.0))
    n = lambda v: F.lit(float(v))
    one = F.array(F.struct(F.lit("video").alias("kind"), g.box(n(0), n(0), n(607.5), n(1080)).alias("src"), g.box(n(0), n(0), n(1080), n(1920)).alias("dst"), F.lit(1).alias("z")))
    segments = clips.select("clip_id", F.lit(0.0).alias("start"), F.lit(30 * 86400.0).alias("end"), one.alias("layers"))
    got = layout.band_coverage(t, segments, clips, layout.caption_bands(60.0))
    return got.select("clip_id", F.round("bottom", 6).alias("bottom"), F.round("top", 6).alias("top"))


def _clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as clips of several sizes and strategies, a month long; users' values as tracks of some of them, views as faces."""
    from tidemark.functions import geometry as g

    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    cam = F.when(size % 3 == 0, g.box(F.lit(0.7), F.lit(0.7), F.lit(0.25), F.lit(0.25)))
    clips = p.select(
        key.alias("clip_id"), F.element_at(F.array(F.lit("auto"), F.lit("irl"), F.lit("gaming"), F.lit("conversation"), F.lit("fit_blur")), (size % 5 + 1).cast("int")).alias("requested"),
        (size * 40 + 200).alias("source_width"), (size * 25 + 100).alias("source_height"), F.lit(30 * 86400.0).alias("duration"), cam.alias("facecam"), (key % 2 == 0).alias("facecam_auto"),
    )
    return clips, _track(spark, sf_dir).withColumn("width", F.when(F.col("height") > 0, 0.1).otherwise(0.0)).drop("duration")


def layout_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = layout.plan(*_clips(spark, sf_dir))["plans"]
    return got.select("clip_id", "requested", "strategy", "upscale_factor", "caption_prefer_top", "bottom_coverage", "facecam_source", F.array_join("warnings", ",").alias("warnings"))


def derived_facecams(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips, points = _clips(spark, sf_dir)
    return layout.facecam_from_track(points, clips, aspect=layout.panel_aspect()).select("clip_id", *(F.round(F.col(f"box.{c}"), 6).alias(c) for c in "xywh"))


def snapped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of customers on pictures with a step at some row, some with a face that must stay inside."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip_id"))
    of = F.col("clip_id")
    seam = F.when(of % 5 == 0, 999).otherwise(of % 31 + 24)
    pixel = lambda k: (F.col("row") * 7 + k * 3 + F.col("frame")) % 5 + F.when(F.col("row") >= seam, 150).otherwise(50)
    frames = c.select(of, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("frame")).select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("row"))
    frames = frames.select("clip_id", "frame", "row", F.array(*(pixel(k) for k in range(16))).alias("values"))
    edge = lambda v: F.lit(float(v)).alias
    boxes = c.select(of, F.struct(edge(0)("x"), (of % 7 * 0.05).alias("y"), edge(1)("w"), (of % 3 * 0.1 + 0.5).alias("h")).alias("box"))
    faces = c.filter(of % 4 == 0).select(of, F.lit(0.5).alias("x"), F.lit(0.55).alias("y"), F.lit(0.4).alias("width"), F.lit(0.2).alias("height"))
    got = track.snap_to_seams(frames, boxes, faces)
    return got.select("clip_id", *(F.round(F.col(f"box.{k}"), 6).alias(k) for k in "xywh"), F.round("strength", 6).alias("strength"))


def face_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as boxes in daily frames of a user; the chosen face's track."""
    e = _seconds(events(spark, sf_dir))
    boxes = e.select(F.col("user_id").alias("clip_id"), F.floor(F.col("t") / 86400).alias("frame"), F.when(F.col("event_type") == "view", 0.1).otherwise(0.6).alias("x"), F.lit(0.2).alias("y"), (F.col("value") % 10 / 100 + 0.1).alias("w"), (F.col("value") % 10 / 100 + 0.1).alias("h"))
    frames = e.select(F.col("user_id").alias("clip_id")).distinct().withColumn("total_frames", F.lit(30).cast("long"))
    return track.face_track(boxes, frames, 1.0).select("clip_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("width", 6).alias("width"))


_E = f"{EVENTS}, s AS (SELECT *, (us - {START}) / 1000000.0::DOUBLE AS t FROM e)"
_HIST = lambda name, where: f"{name} AS (SELECT u.user_id, b.bin, coalesce(c.n, 0)::DOUBLE AS v FROM (SELECT DISTINCT user_id FROM s WHERE {where}) u CROSS JOIN (SELECT unnest(range(0, 720)) AS bin) b LEFT JOIN (SELECT user_id, least(719, greatest(0, trunc(t / 3600.0::DOUBLE)))::BIGINT AS bin, count(*) AS n FROM s WHERE {where} GROUP BY ALL) c USING (user_id, bin))"
_Z = lambda name, src: f"{name} AS (SELECT user_id, bin, CASE WHEN stddev_pop(v) OVER w <= 1e-9 THEN 0.0 ELSE (v - avg(v) OVER w) / stddev_pop(v) OVER w END AS z FROM {src} WINDOW w AS (PARTITION BY user_id))"
_BEST = "b AS (SELECT user_id AS candidate_id, t AS source_ts FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, t) = 1)"
_TR = f"""{_E}, r AS (SELECT user_id AS clip_id, seq, t, (value % 100) / 100 AS x, (t % 86400) / 86400 AS y, CASE WHEN event_type = 'view' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS height FROM s)"""
_SNAP = lambda at, edge, to, tolerance: f"""coalesce((SELECT {to} FROM w WHERE w.candidate_id = h.candidate_id AND ws < {at} AND {at} < we ORDER BY ws, we LIMIT 1),
 (SELECT CASE WHEN n.d > 0 AND n.d <= {tolerance} THEN n.e END FROM (SELECT min({{'d': abs({edge} - {at}), 'e': {edge}}}) AS n FROM quiet WHERE quiet.candidate_id = h.candidate_id) z), {at})"""  # noqa: E731
_DECIDED = f"""{_E}, {_BEST},
c AS (SELECT candidate_id, source_ts AS mid, greatest(0.0, source_ts - 3600.0) AS lo, source_ts + 7200.0 AS hi FROM b),
w AS (SELECT candidate_id, t AS ws, t + value * 10 AS we FROM c JOIN s ON user_id = candidate_id WHERE t + value * 10 > lo AND t < hi AND t + value * 10 > t),
wf AS (SELECT *, CASE WHEN ws - max(we) OVER (PARTITION BY candidate_id ORDER BY ws, we ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 60.0 THEN 0 ELSE 1 END AS fresh FROM w),
wi AS (SELECT *, sum(fresh) OVER (PARTITION BY candidate_id ORDER BY ws, we ROWS UNBOUNDED PRECEDING) AS i FROM wf),
u AS (SELECT candidate_id, i, min(ws) AS us, max(we) AS ue FROM wi GROUP BY ALL),
un AS (SELECT *, lag(us) OVER o AS pus, lag(ue) OVER o AS pue FROM u WINDOW o AS (PARTITION BY candidate_id ORDER BY i)),
quiet AS (SELECT * FROM (SELECT candidate_id, greatest(coalesce(pue, lo), lo) AS qs, least(us, hi) AS qe FROM un JOIN c USING (candidate_id) UNION ALL SELECT candidate_id, greatest(max(ue), any_value(lo)), any_value(hi) FROM u JOIN c USING (candidate_id) GROUP BY candidate_id) q WHERE qe > qs),
main AS (SELECT candidate_id, ue, pus FROM un JOIN c USING (candidate_id) WHERE us <= mid AND mid <= ue QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY i) = 1),
near AS (SELECT candidate_id, mid, t, value FROM c JOIN s ON user_id = candidate_id WHERE t BETWEEN lo AND hi),
bk AS (SELECT candidate_id, k FROM c CROSS JOIN (SELECT unnest(range(1, 7)) AS k) k WHERE (SELECT count(*) FROM near WHERE near.candidate_id = c.candidate_id AND near.t > c.mid + k * 300.0 - 600.0 AND near.t <= c.mid + k * 300.0) / 600.0::DOUBLE >= 1.0::DOUBLE / 300),
burst AS (SELECT candidate_id, max(k) AS k FROM bk GROUP BY 1),
base AS (SELECT candidate_id, median(value) AS base FROM near WHERE t BETWEEN mid - 30.0 AND mid GROUP BY 1),
dec AS (SELECT near.candidate_id, min(t) AS decay FROM near LEFT JOIN base USING (candidate_id) WHERE t BETWEEN mid AND mid + 1800.0 AND value < greatest(0.02::DOUBLE, 1.5::DOUBLE * coalesce(base, 0.02::DOUBLE)) GROUP BY 1),
pay AS (SELECT c.*, main.pus, (SELECT count(*) FROM u WHERE u.candidate_id = c.candidate_id) AS said,
  greatest(greatest(mid, coalesce(main.ue, mid)), least(greatest(least(mid + coalesce(k, 0) * 300.0, mid + 1800.0), decay), mid + 1800.0)) AS payoff
  FROM c LEFT JOIN main USING (candidate_id) LEFT JOIN burst USING (candidate_id) LEFT JOIN dec USING (candidate_id)),
h AS (SELECT *, greatest(lo, least(CASE WHEN pus IS NOT NULL THEN greatest(mid - 3600.0, least(pus, mid - 300.0)) WHEN said = 0 THEN mid ELSE mid - 3600.0 END, mid)) AS hook,
  coalesce((SELECT min(qs) FROM quiet WHERE quiet.candidate_id = pay.candidate_id AND qs >= payoff), payoff) AS stop FROM pay),
k0 AS (SELECT *, greatest(lo, {_SNAP('h.hook', 'qs', 'ws', 600.0)}) AS a, {_SNAP('h.stop', 'qe', 'we', 900.0)} AS z FROM h),
k1 AS (SELECT * REPLACE (least(a, z) AS a, greatest(a, z) AS z) FROM k0),
k2 AS (SELECT * REPLACE (CASE WHEN a > mid THEN greatest(lo, mid - 300.0) ELSE a END AS a, greatest(z, payoff) AS z), a > mid AS late, z < payoff AS opened FROM k1),
k3 AS (SELECT *, least(greatest(a, z - 5400.0), greatest(lo, mid - 300.0)) AS moved FROM k2),
k4 AS (SELECT * REPLACE (CASE WHEN z - a > 5400.0 AND moved > a THEN moved ELSE a END AS a), z - a > 5400.0 AND moved > a AS first_cut FROM k3),
k5 AS (SELECT * REPLACE (CASE WHEN z - a > 5400.0 THEN a + 5400.0 ELSE z END AS z), z - a > 5400.0 AS last_cut FROM k4),
k6 AS (SELECT *, z - a < 600.0 AS short, least(hi, a + 600.0) - a >= 600.0 AS room FROM k5),
k7 AS (SELECT * REPLACE (CASE WHEN short AND NOT room THEN least(a, greatest(lo, z - 600.0)) ELSE a END AS a) FROM k6),
k8 AS (SELECT * REPLACE (CASE WHEN short THEN least(hi, a + 600.0) ELSE z END AS z) FROM k7),
k9 AS (SELECT * REPLACE (greatest(lo, a) AS a) FROM k8),
own AS (SELECT * REPLACE (least(hi, greatest(z, a)) AS z) FROM k9)"""
#: The hard rules with their defaults, over rows of a, z (start, end), mid, payoff, lo and hi.
_RULES = """k1 AS (SELECT * REPLACE (least(a, z) AS a, greatest(a, z) AS z) FROM k0),
k2 AS (SELECT * REPLACE (CASE WHEN a > mid THEN greatest(lo, mid - 1.5) ELSE a END AS a, greatest(z, payoff) AS z), a > mid AS late, z < payoff AS opened FROM k1),
k3 AS (SELECT *, least(greatest(a, z - 45.0), greatest(lo, mid - 1.5)) AS moved FROM k2),
k4 AS (SELECT * REPLACE (CASE WHEN z - a > 45.0 AND moved > a THEN moved ELSE a END AS a), z - a > 45.0 AND moved > a AS first_cut FROM k3),
k5 AS (SELECT * REPLACE (CASE WHEN z - a > 45.0 THEN a + 45.0 ELSE z END AS z), z - a > 45.0 AS last_cut FROM k4),
k6 AS (SELECT *, z - a < 10.0 AS short, least(hi, a + 10.0) - a >= 10.0 AS room FROM k5),
k7 AS (SELECT * REPLACE (CASE WHEN short AND NOT room THEN least(a, greatest(lo, z - 10.0)) ELSE a END AS a) FROM k6),
k8 AS (SELECT * REPLACE (CASE WHEN short THEN least(hi, a + 10.0) ELSE z END AS z) FROM k7),
k9 AS (SELECT * REPLACE (greatest(lo, a) AS a) FROM k8),
own AS (SELECT * REPLACE (least(hi, greatest(z, a)) AS z) FROM k9)"""
_SAID = """concat_ws('; ', CASE WHEN late THEN 'start moved back before the main event' END, CASE WHEN opened THEN 'end extended to the payoff' END, CASE WHEN first_cut THEN 'start trimmed to the ceiling' END,
  CASE WHEN last_cut THEN 'end trimmed to the ceiling' END, CASE WHEN short THEN 'extended to the minimum length' END) AS rules"""
_REVIEW = f"""{_E}, a AS (SELECT seq AS candidate_id, t, value, greatest(0.0, t - value / 2) AS s0, t + value AS e0 FROM s),
z AS (SELECT *, CASE WHEN e0 - s0 > 45.0 THEN 45.0::DOUBLE WHEN e0 - s0 < 10.0 THEN 10.0::DOUBLE END AS size FROM a),
c AS (SELECT *, CASE WHEN size IS NULL THEN s0 ELSE greatest(0.0, t - size / 2) END AS s1 FROM z), d AS (SELECT *, CASE WHEN size IS NULL THEN e0 ELSE s1 + size END AS e1 FROM c), m AS (SELECT *, least(greatest(t, s1), e1) AS mt FROM d)"""
_PROPOSED = f"""WITH {_REVIEW}, k0 AS (SELECT candidate_id, CASE WHEN candidate_id % 3 > 0 THEN t - value / 4 + 5 ELSE s1 END AS a, CASE WHEN candidate_id % 3 > 1 THEN t + value ELSE e1 END AS z, mt AS mid, least(e1, mt + 3.0) AS payoff, greatest(0.0, t - 60) AS lo, t + 90 AS hi FROM m),
{_RULES}
SELECT candidate_id, round(a, 6) AS start, round(z, 6) AS "end", round(mid, 6) AS main_ts, round(payoff, 6) AS payoff_ts, {_SAID} FROM own"""
_PLANS = f"""WITH {_DECIDED}, top AS (SELECT user_id AS candidate_id FROM s GROUP BY 1 ORDER BY max(value) DESC, arg_min(t, {{'a': -value, 'b': t}}), user_id LIMIT 20)
SELECT candidate_id, round(a, 3) AS start, round(z, 3) AS "end", CASE candidate_id % 3 WHEN 0 THEN 'irl' ELSE '' END AS strategy, CASE candidate_id % 3 WHEN 0 THEN 'minimal' ELSE 'karaoke_highlight' END AS style FROM own JOIN top USING (candidate_id)"""
_BOUNDS = f"""WITH {_DECIDED}
SELECT candidate_id, round(a, 3) AS start, round(z, 3) AS "end", round(mid, 3) AS main_ts, round(least(greatest(hook, a), z), 3) AS hook_ts, round(least(greatest(payoff, a), z), 3) AS payoff_ts, 'signal_evidence' AS method, {_SAID} FROM own"""
_STEADY = lambda band: f"""{_TR}, n AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY t, seq) AS rn FROM r),
g AS (SELECT clip_id, rn, x, 0.0::DOUBLE AS start, 1 AS k FROM n WHERE rn = 1 UNION ALL
 SELECT n.clip_id, n.rn, CASE WHEN abs(n.x - g.x) >= {band}::DOUBLE THEN n.x ELSE g.x END, CASE WHEN abs(n.x - g.x) >= {band}::DOUBLE THEN n.t ELSE g.start END, CASE WHEN abs(n.x - g.x) >= {band}::DOUBLE THEN g.k + 1 ELSE g.k END FROM g JOIN n ON n.clip_id = g.clip_id AND n.rn = g.rn + 1),
d AS (SELECT DISTINCT clip_id, k, start, x FROM g)"""  # noqa: E731
_CAPPED = f"""WITH RECURSIVE {_STEADY(0.02)},
c AS (SELECT clip_id, list(start ORDER BY k) AS starts, list(x ORDER BY k) AS xs FROM d GROUP BY clip_id
 UNION ALL
 SELECT clip_id, starts[1:j] || starts[j + 2:], CASE WHEN j = 1 THEN xs[2:] ELSE xs[1:j - 1] || xs[j + 1:] END
 FROM (SELECT *, list_position(steps, list_min(steps)) AS j FROM (SELECT *, list_transform(range(1, len(xs)), lambda i: abs(xs[i + 1] - xs[i])) AS steps FROM c WHERE len(xs) > 24) a) b),
f AS (SELECT clip_id, starts || [2592000.0::DOUBLE] AS edges, xs FROM c WHERE len(xs) <= 24),
l AS (SELECT clip_id, edges, xs, unnest(range(1, len(xs) + 1)) AS i FROM f)
SELECT clip_id, round(edges[i], 2) AS start, round(edges[i + 1], 2) AS "end", round(xs[i], 6) AS x FROM l WHERE edges[i + 1] > edges[i]"""
_FACES = f"""WITH RECURSIVE {_E},
b AS (SELECT user_id AS clip_id, floor(t / 86400)::BIGINT AS frame, CASE WHEN event_type = 'view' THEN 0.1::DOUBLE ELSE 0.6::DOUBLE END AS x, 0.2::DOUBLE AS y, (value % 10) / 100 + 0.1::DOUBLE AS w FROM s),
n AS (SELECT *, x + w / 2 AS cx, y + w / 2 AS cy, w * w AS area, row_number() OVER (PARTITION BY clip_id ORDER BY frame, w * w DESC, x, y) AS rn FROM b),
f AS (SELECT clip_id, rn, [{{'cx': cx, 'cy': cy, 'area': area, 'frame': frame}}] AS faces, 1::BIGINT AS mine FROM n WHERE rn = 1
 UNION ALL
 SELECT clip_id, rn, CASE WHEN k IS NULL THEN faces || [own] WHEN faces[k].frame = own.frame THEN faces ELSE list_transform(range(1, len(faces) + 1), lambda i: CASE WHEN i = k THEN own ELSE faces[i] END) END,
        CASE WHEN k IS NULL THEN len(faces) + 1 WHEN faces[k].frame = own.frame THEN NULL ELSE k END
 FROM (SELECT clip_id, rn, faces, own, list_sort(list_filter(list_transform(range(1, len(faces) + 1), lambda i: {{'d': sqrt((own.cx - faces[i].cx) * (own.cx - faces[i].cx) + (own.cy - faces[i].cy) * (own.cy - faces[i].cy)), 'i': i, 'area': faces[i].area}}),
         lambda c: c.d <= 0.15::DOUBLE AND (c.area <= 0 OR own.area BETWEEN c.area / 2.5::DOUBLE AND c.area * 2.5::DOUBLE)))[1].i AS k
       FROM (SELECT n.clip_id, n.rn, f.faces, {{'cx': n.cx, 'cy': n.cy, 'area': n.area, 'frame': n.frame}} AS own FROM f JOIN n ON n.clip_id = f.clip_id AND n.rn = f.rn + 1) j) q),
o AS (SELECT n.clip_id, n.frame, f.mine, n.x, n.y, n.w FROM n JOIN f USING (clip_id, rn) WHERE f.mine IS NOT NULL),
v AS (SELECT clip_id, mine, count(*) / 30 AS persistence, median(w * w) AS area FROM o GROUP BY ALL HAVING count(*) >= 4),
win AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY persistence * area DESC, persistence DESC, area DESC, mine) = 1),
h AS (SELECT o.* FROM o JOIN win USING (clip_id, mine) WHERE persistence >= 0.2::DOUBLE),
sp AS (SELECT clip_id, unnest(range(0, 30)) AS frame FROM (SELECT DISTINCT clip_id FROM h) d),
c AS (SELECT sp.clip_id, sp.frame, last_value(h.x + h.w / 2 IGNORE NULLS) OVER u AS x, last_value(h.y + h.w / 2 IGNORE NULLS) OVER u AS y, last_value(h.w IGNORE NULLS) OVER u AS w FROM sp LEFT JOIN h USING (clip_id, frame) WINDOW u AS (PARTITION BY sp.clip_id ORDER BY sp.frame ROWS UNBOUNDED PRECEDING))
SELECT clip_id, frame AS seq, round(greatest(0.0, least(1.0, coalesce(x, 0.5))), 6) AS x, round(greatest(0.0, least(1.0, coalesce(y, 0.5))), 6) AS y, round(coalesce(w, 0.0), 6) AS width FROM c"""
_NCC = """WITH v AS (SELECT vec_id AS clip_id, embedding::DOUBLE[] AS e, len(embedding) // 4 AS q FROM embeddings),
a AS (SELECT clip_id, q, list_transform(e, lambda x: x - list_avg(e)) AS w, e[q + 1:q + q] AS raw FROM v),
c AS (SELECT clip_id, q, w, list_transform(raw, lambda x: x - list_avg(raw)) AS c FROM a),
l AS (SELECT clip_id, q, w, c, unnest(range(0, len(w) - q + 1)) AS lag FROM c),
p AS (SELECT clip_id, lag, c, w[lag + 1:lag + q] AS part FROM l),
s AS (SELECT clip_id, lag, CASE WHEN sqrt(list_dot_product(part, part)) > 1e-9 THEN list_dot_product(c, part) / (sqrt(list_dot_product(c, c)) * sqrt(list_dot_product(part, part))) ELSE 0.0 END AS score FROM p),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY round(score, 9) DESC, lag) = 1)
SELECT clip_id, CASE WHEN score > 0 THEN lag ELSE 0 END AS lag, round(greatest(score, 0.0), 4) AS score FROM m"""
_CLIPS = f"""{_TR}, p AS (SELECT p_partkey AS clip_id, ['auto', 'irl', 'gaming', 'conversation', 'fit_blur'][p_size % 5 + 1] AS requested, (p_size * 40 + 200)::DOUBLE AS sw, (p_size * 25 + 100)::DOUBLE AS sh, p_size % 3 = 0 AS given, p_partkey % 2 = 0 AND p_size % 3 <> 0 AS asks FROM part),
seen AS (SELECT clip_id, median(x) AS mx, median(y) AS my FROM r WHERE height > 0 GROUP BY 1 HAVING count(*) >= 4),
tw AS (SELECT p.clip_id, sw, sh, mx, my, greatest(0.1::DOUBLE * 1.6::DOUBLE * sw, 0.22::DOUBLE * sw) AS w0, 0.2::DOUBLE * 1.6::DOUBLE * sh AS fh FROM p JOIN seen USING (clip_id)),
th AS (SELECT *, least(sw, w0) AS w1, greatest(least(sw, w0) / (1080.0::DOUBLE / 768), fh) AS h1 FROM tw),
tile AS (SELECT *, least(CASE WHEN w1 / (1080.0::DOUBLE / 768) < fh THEN h1 * (1080.0::DOUBLE / 768) ELSE w1 END, sw) AS w, least(h1, sh) AS h FROM th),
cams AS (SELECT clip_id, least(greatest(mx * sw - w / 2, 0), sw - w) / sw AS x, least(greatest(my * sh - h / 2, 0), sh - h) / sh AS y, w / sw AS w, h / sh AS h FROM tile)"""
_LAYOUT = f"""WITH {_CLIPS},
a AS (SELECT p.*, CASE WHEN given THEN 0.25::DOUBLE * sw WHEN asks THEN cams.w * sw END AS cw, CASE WHEN given THEN 0.25::DOUBLE * sh WHEN asks THEN cams.h * sh END AS ch, CASE WHEN given THEN 0.7::DOUBLE * sh WHEN asks THEN cams.y * sh END AS cy FROM p LEFT JOIN cams USING (clip_id)),
f AS (SELECT *, CASE WHEN requested <> 'auto' THEN requested WHEN cw IS NOT NULL THEN 'gaming' WHEN least(sw, sh) >= 720 THEN 'irl' ELSE 'fit_blur' END AS one FROM a),
q AS (SELECT *, requested = 'auto' AND cw IS NULL AND least(sw, sh) < 720 OR one IN ('irl', 'conversation') AND sh < 720 AS low, one = 'gaming' AND cw IS NULL AS missing,
  CASE WHEN one IN ('irl', 'conversation') AND sh < 720 OR one = 'gaming' AND cw IS NULL THEN 'fit_blur' ELSE one END AS strategy FROM f),
g AS (SELECT *, CASE strategy WHEN 'irl' THEN 1920 / sh WHEN 'gaming' THEN greatest(1152 / least(sh, sw / (1080.0 / 1152)), greatest(1080 / least(cw, ch * (1080.0 / 768)), 768 / least(ch, cw / (1080.0 / 768))))
  WHEN 'conversation' THEN 1080 / (sw / 2) ELSE least(1080.0, 1920 * sw / sh) / sw END AS factor FROM q),
pt AS (SELECT clip_id, y, CASE WHEN height > 0 THEN height / 2 ELSE 0.125 END AS half FROM r WHERE t < 2592000.0),
ly AS (SELECT clip_id, l.* FROM g, LATERAL (SELECT unnest(CASE strategy WHEN 'irl' THEN [{{'sy': 0.0::DOUBLE, 'sh2': sh, 'dy': 0.0::DOUBLE, 'dh': 1920.0::DOUBLE}}]
   WHEN 'conversation' THEN [{{'sy': (sh - sw / 2 / (1080.0 / 956)) / 2, 'sh2': sw / 2 / (1080.0 / 956), 'dy': 0.0, 'dh': 956.0}}, {{'sy': (sh - sw / 2 / (1080.0 / 956)) / 2, 'sh2': sw / 2 / (1080.0 / 956), 'dy': 964.0, 'dh': 956.0}}]
   WHEN 'fit_blur' THEN [{{'sy': 0.0, 'sh2': sh, 'dy': (1920 - least(1080.0, 1920 * sw / sh) / (sw / sh)) / 2, 'dh': least(1080.0, 1920 * sw / sh) / (sw / sh)}}]
   ELSE [{{'sy': 0.0, 'sh2': sh, 'dy': 0.0, 'dh': 1152.0}}, {{'sy': cy + (ch - least(ch, cw / (1080.0 / 768))) / 2, 'sh2': least(ch, cw / (1080.0 / 768)), 'dy': 1152.0, 'dh': 768.0}}] END, max_depth := 2)) l),
mt AS (SELECT pt.clip_id, bool_or(y * sh BETWEEN sy AND sy + sh2 AND dy + (greatest(0, y - half) * sh - sy) * (dh / sh2) <= 1660 AND dy + (least(1, y + half) * sh - sy) * (dh / sh2) >= 1465) AS low,
  bool_or(y * sh BETWEEN sy AND sy + sh2 AND dy + (greatest(0, y - half) * sh - sy) * (dh / sh2) <= 455 AND dy + (least(1, y + half) * sh - sy) * (dh / sh2) >= 260) AS top FROM (SELECT *, row_number() OVER () AS n FROM pt) pt JOIN ly USING (clip_id) JOIN p USING (clip_id) GROUP BY pt.clip_id, n),
cv AS (SELECT clip_id, avg(low::INT) AS low, avg(top::INT) AS top FROM mt GROUP BY 1),
o AS (SELECT g.*, coalesce(cv.low, 0.0) AS cover, strategy <> 'gaming' AND coalesce(cv.low, 0) > 0.25 AND cv.low >= cv.top AS busy FROM g LEFT JOIN cv USING (clip_id))
SELECT clip_id, requested, strategy, round(cover, 4) AS bottom_coverage, round(greatest(1.0, factor), 3) AS upscale_factor, strategy = 'gaming' OR busy AS caption_prefer_top, CASE WHEN strategy = 'gaming' THEN CASE WHEN asks THEN 'auto' ELSE 'config' END ELSE '' END AS facecam_source,
 concat_ws(',', CASE WHEN low THEN 'low_resolution_layout' END, CASE WHEN missing THEN 'facecam_box_missing' END, CASE WHEN asks AND cw IS NULL THEN 'facecam_box_auto_failed' END, CASE WHEN asks AND cw IS NOT NULL AND one = 'gaming' THEN 'facecam_box_auto' END,
  CASE WHEN factor > 2 THEN 'upscale_exceeds_threshold' END, CASE WHEN busy THEN 'caption_band_moved' END) AS warnings FROM o"""
_SNAPPED = """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 999 ELSE c_custkey % 31 + 24 END AS seam, c_custkey % 7 * 0.05::DOUBLE AS y, c_custkey % 3 * 0.1::DOUBLE + 0.5::DOUBLE AS h FROM customer),
t AS (SELECT *, least(round_even(y * 64, 0), 63)::INT AS y0, least(64, round_even((y + h) * 64, 0))::INT AS y1 FROM c),
k AS (SELECT *, greatest(3, round_even(0.12 * (y1 - y0), 0)) AS band, greatest(1, round_even(0.15 * (y1 - y0), 0)) AS reach, greatest(8, round_even(0.25 * (y1 - y0), 0)) AS stay FROM t),
v AS (SELECT seam, f, r, list_transform(range(0, 16), lambda k: (r * 7 + k * 3 + f) % 5 + CASE WHEN r >= seam THEN 150 ELSE 50 END) AS v FROM (SELECT DISTINCT seam FROM c) s, range(0, 3) f(f), range(0, 64) r(r)),
d AS (SELECT seam, f, r, v, lag(v) OVER (PARTITION BY seam, f ORDER BY r) AS w FROM v),
s AS (SELECT seam, r, median(list_avg(list_transform(range(1, 17), lambda i: abs(v[i] - w[i])))) AS step FROM d WHERE r > 0 GROUP BY ALL),
e AS (SELECT id, edge, arg_max(r, {'a': step, 'b': -r}) AS r, max(step) AS step, median(step) AS usual FROM (SELECT id, seam, band, unnest(['low', 'top']) AS edge, unnest([y1 - 1, y0]) AS at_row FROM k) q JOIN s ON s.seam = q.seam AND s.r BETWEEN at_row + 1 - band AND at_row + 1 + band GROUP BY ALL),
g AS (SELECT * FROM e WHERE step >= 8 AND step >= 2.5 * usual),
m AS (SELECT k.*, l.r AS lr, l.step AS ls, u.r AS ur, u.step AS us, k.id % 4 = 0 AS face FROM k LEFT JOIN g l ON l.id = k.id AND l.edge = 'low' LEFT JOIN g u ON u.id = k.id AND u.edge = 'top'),
a AS (SELECT *, coalesce(abs(lr - y1) <= reach AND lr - y0 >= stay AND (NOT face OR (y0 / 64 <= 0.45 + 1e-6 AND lr / 64 >= 0.65 - 1e-6)), FALSE) AS lower FROM m),
b AS (SELECT *, CASE WHEN lower THEN lr ELSE y1 END AS bottom FROM a),
z AS (SELECT *, coalesce(abs(ur - y0) <= reach AND bottom - ur >= stay AND (NOT face OR (ur / 64 <= 0.45 + 1e-6 AND bottom / 64 >= 0.65 - 1e-6)), FALSE) AS upper FROM b),
n AS (SELECT *, CASE WHEN upper THEN ur ELSE y0 END AS above FROM z)
SELECT id AS clip_id, 0.0::DOUBLE AS x, round(CASE WHEN above <> y0 OR bottom <> y1 THEN above / 64 ELSE y END, 6) AS y, 1.0::DOUBLE AS w, round(CASE WHEN above <> y0 OR bottom <> y1 THEN (bottom - above) / 64 ELSE h END, 6) AS h,
 round(CASE WHEN above <> y0 OR bottom <> y1 THEN greatest(CASE WHEN lower THEN ls END, CASE WHEN upper THEN us END) ELSE 0.0 END, 6) AS strength FROM n"""
_COVER = lambda a, b: f"avg(CASE WHEN greatest(0.0, y - h) * 1080 * 1920 / 1080 <= {b} AND least(1.0, y + h) * 1080 * 1920 / 1080 >= {a} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"

QUERIES = {f.__name__: f for f in (timeline_offset, sliding_ncc, verified_offset, baseline_median, burst_end, level_decay, bounds_decision, review_windows, proposed_bounds, edit_plans, deadband_segments, capped_segments, centroids, crop_centers, coverage_ratio, layout_plans, derived_facecams, snapped_boxes, face_tracks)}
ORACLE_SQL = {
    "timeline_offset": f"""WITH {_E}, {_HIST('ha', "event_type = 'click'")}, {_HIST('hb', "event_type <> 'click'")}, {_Z('za', 'ha')}, {_Z('zb', 'hb')},
x AS (SELECT za.user_id, zb.bin - za.bin AS lag, sum(za.z * zb.z) AS total FROM za JOIN zb ON za.user_id = zb.user_id AND zb.bin BETWEEN za.bin - 24 AND za.bin + 24 GROUP BY ALL),
m AS (SELECT user_id, lag, total FROM x QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(total, 9) DESC, lag) = 1),
n AS (SELECT user_id, (SELECT count(*) FROM ha WHERE ha.user_id = u.user_id AND v > 0) AS a, (SELECT count(*) FROM hb WHERE hb.user_id = u.user_id AND v > 0) AS c FROM (SELECT DISTINCT user_id FROM ha INTERSECT SELECT DISTINCT user_id FROM hb) u)
SELECT n.user_id, CASE WHEN a >= 3 AND c >= 3 THEN lag ELSE 0 END AS lag, round(CASE WHEN a >= 3 AND c >= 3 THEN greatest(0.0, total / 720) ELSE 0.0 END, 6) AS score, a AS active_first, c AS active_second FROM n LEFT JOIN m USING (user_id)""",
    "verified_offset": f"""WITH {_E}, o AS (SELECT user_id, value / 100 AS score, t / 3600 AS off FROM s)
SELECT user_id, round(coalesce(median(off) FILTER (WHERE score >= 0.6), 0.0), 5) AS "offset", round(CASE WHEN count(*) FILTER (WHERE score >= 0.6) > 0 THEN avg(score) ELSE max(score) END, 6) AS score, count(*) AS checked, count(*) FILTER (WHERE score >= 0.6) AS confident,
 CASE WHEN count(*) FILTER (WHERE score >= 0.6) > 0 THEN avg(score) ELSE max(score) END >= 0.6 AS is_confident FROM o GROUP BY user_id""",
    "baseline_median": f"WITH {EVENTS} SELECT us // 86400000000 AS day, round(median(value), 6) AS median FROM e GROUP BY 1",
    "burst_end": f"""WITH {_E}, {_BEST}, c AS (SELECT candidate_id, source_ts, k, (SELECT count(*) FROM s WHERE s.user_id = candidate_id AND s.t > source_ts + 3600.0 * k - 7200.0 AND s.t <= source_ts + 3600.0 * k) AS n FROM b, range(1, 11) r(k))
SELECT candidate_id, round(source_ts + least(coalesce(max(3600.0 * k) FILTER (WHERE n / 7200.0::DOUBLE >= 1.0::DOUBLE / 7200), 0.0), 36000.0), 3) AS burst_end FROM c GROUP BY candidate_id, source_ts""",
    "level_decay": f"""WITH {_E}, {_BEST}, m AS (SELECT candidate_id, source_ts, median(value) AS base FROM b JOIN s ON user_id = candidate_id AND t BETWEEN source_ts - 864000.0 AND source_ts GROUP BY ALL)
SELECT candidate_id, round(min(t), 3) AS decay FROM m JOIN s ON user_id = candidate_id AND t BETWEEN source_ts AND source_ts + 864000.0 WHERE value < greatest(0.02::DOUBLE, 1.5::DOUBLE * base) GROUP BY candidate_id""",
    "review_windows": f"""WITH {_REVIEW}
SELECT candidate_id, round(s1, 6) AS start, round(e1, 6) AS "end", round(mt, 6) AS main_ts, round(greatest(s1, mt - 30.0), 6) AS hook_ts, round(least(e1, mt + 3.0), 6) AS payoff_ts FROM m""",
    "proposed_bounds": _PROPOSED,
    "edit_plans": _PLANS,
    "sliding_ncc": _NCC,
    "bounds_decision": _BOUNDS,
    "deadband_segments": f"""WITH RECURSIVE {_STEADY(0.3)}, l AS (SELECT clip_id, start, coalesce(lead(start) OVER (PARTITION BY clip_id ORDER BY k), 2592000.0) AS stop, x FROM d)
SELECT clip_id, round(start, 2) AS start, round(stop, 2) AS "end", round(x, 6) AS x FROM l WHERE stop > start""",
    "capped_segments": _CAPPED,
    "layout_plans": _LAYOUT,
    "derived_facecams": f"WITH {_CLIPS} SELECT clip_id, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM cams",
    "snapped_boxes": _SNAPPED,
    "face_tracks": _FACES,
    "centroids": f"""WITH {_E}, h AS (SELECT user_id, floor((t % 86400) / 3600) AS place, sum(value) AS energy FROM s GROUP BY ALL)
SELECT user_id, round(CASE WHEN sum(energy) <= 1e-9 THEN 0.5 ELSE 0.65::DOUBLE * (sum(energy * (place + 0.5)) / 24 / sum(energy)) + 0.175::DOUBLE END, 6) AS center FROM h GROUP BY user_id""",
    "crop_centers": f"""WITH {_TR}, l AS (SELECT clip_id, list_sort(list(y) FILTER (WHERE height > 0)) AS ys FROM r GROUP BY clip_id)
SELECT clip_id, round(CASE WHEN coalesce(len(ys), 0) = 0 THEN 0.5 ELSE greatest(0.25, least(0.75, ys[len(ys) // 2 + 1])) END, 6) AS crop_y FROM l""",
    "coverage_ratio": f"""WITH {_TR}, p AS (SELECT clip_id, y, CASE WHEN height > 0 THEN height / 2 ELSE 0.125 END AS h FROM r WHERE t < 2592000.0)
SELECT clip_id, round({_COVER(1510.0, 1660.0)}, 6) AS bottom, round({_COVER(260.0, 410.0)}, 6) AS top FROM p GROUP BY clip_id""",
}
