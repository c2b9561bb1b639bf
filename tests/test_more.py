"""Operators that no query covers: words and segments, facecam tiles, plans, proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import alignment, bounds, layout, messages, metadata, store, track
from tidemark.plans import editing

WORD = "start double, end double, text string"


def test_words_attach_to_every_segment_they_touch(spark):
    segments = spark.createDataFrame([("a", 1, 0.0, 5.0), ("a", 2, 5.0, 9.0), ("a", 3, 70.0, 71.0)], "k string, segment_id long, start double, end double")
    words = spark.createDataFrame([("a", 1.0, 2.0, "one"), ("a", 4.5, 5.5, "both"), ("a", 8.0, 8.5, "two")], f"k string, {WORD}")
    got = {r.segment_id: None if r.words is None else [w.text for w in r.words] for r in messages.attach_words(segments, words, ["k"]).collect()}
    assert got == {1: ["one", "both"], 2: ["both", "two"], 3: None}


def test_transcript_words_own_or_made(spark):
    rows = [("a", 0.0, 2.0, "x y", [(0.1, 0.5, "own")]), ("a", 2.0, 4.0, "made up", []), ("a", 4.0, 5.0, "n", None)]
    df = spark.createDataFrame(rows, f"k string, start double, end double, text string, words array<struct<{WORD.replace(' ', ':').replace(',:', ',')}>>")
    assert [r.text for r in messages.transcript_words(df, ["k"]).orderBy("seq").collect()] == ["own", "made", "up", "n"]


def test_thumbnail_is_in_the_longest_cue(spark):
    clips = spark.createDataFrame([("a", 10.0), ("b", 6.0)], "clip_id string, duration double")
    cues = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 4.0), ("a", 5.0, 7.0)], "clip_id string, start double, end double")
    assert {r.clip_id: r.at for r in messages.thumbnail_time(cues, clips).collect()} == {"a": 3.0, "b": 3.0}


def test_emphasis_answer_is_checked(spark):
    answers = spark.createDataFrame([("a", "Insane, CLUTCH; never insane moon")], "clip_id string, answer string")
    words = spark.createDataFrame([("a", "Insane!"), ("a", "clutch"), ("a", "never")], "clip_id string, text string")
    assert metadata.emphasis_from_answer(answers, words, 2).first().words == ["insane", "clutch"]


def test_caption_gates(spark):
    clips = spark.createDataFrame([(1, False, True, 1), (2, True, False, 1), (3, True, True, 0), (4, True, True, 2)], "clip_id long, has_clip boolean, has_transcript boolean, n_cues long")
    assert [r.reason for r in metadata.caption_outcome(clips).orderBy("clip_id").collect()] == ["no clip", "no transcript", "no cues", None]
    assert metadata.caption_outcome(clips, enabled=False).first().reason == "captions disabled"


def test_facecam_tile_is_the_median_face(spark):
    clips = spark.createDataFrame([("a", 1920, 1080), ("b", 1920, 1080)], "clip_id string, source_width int, source_height int")
    points = [("a", 0.8, 0.7, 0.1, 0.1)] * 5 + [("a", 0.1, 0.1, 0.5, 0.5)] + [("b", 0.5, 0.5, 0.1, 0.1)] * 2
    track = spark.createDataFrame(points, "clip_id string, x double, y double, width double, height double")
    got = layout.facecam_from_track(track, clips).collect()
    assert [r.clip_id for r in got] == ["a"] and round(got[0].box.w, 4) == 0.22
    assert round(got[0].box.x + got[0].box.w / 2, 4) == 0.8 and round(got[0].box.y + got[0].box.h / 2, 4) == 0.7


def test_layout_strategies_draw_their_layers(spark):
    df = spark.createDataFrame([("conversation",), ("gaming",), ("fit_blur",), ("irl",)], "s string")
    from tidemark.functions import geometry as g

    cam = g.box(F.lit(1400.0), F.lit(700.0), F.lit(400.0), F.lit(300.0))
    rows = df.select(F.col("s").alias("strategy"), F.lit(1920).alias("source_width"), F.lit(1080).alias("source_height"), F.lit(0.5).alias("crop_x"), F.lit(0.5).alias("crop_y"), cam.alias("cam"))
    got = {r.strategy: r.layers for r in layout.with_layers(rows).collect()}
    assert [x.kind for x in got["conversation"]] == ["panel", "panel"] and got["conversation"][1].dst.y == 964.0
    assert [x.kind for x in got["gaming"]] == ["video", "panel"] and got["gaming"][1].dst.y == 1152.0
    assert [x.kind for x in got["fit_blur"]] == ["blur", "video"] and round(got["fit_blur"][1].dst.h, 2) == 607.5
    assert round(got["irl"][0].src.x, 2) == round((1920 - 607.5) / 2, 2)


def test_plan_helpers(spark):
    df = spark.createDataFrame([(1920, 1080, "fit_blur"), (1920, 1080, "irl"), (0, 0, "irl")], "w int, h int, s string")
    got = [r.f for r in df.select(editing.plan_upscale(F.col("w"), F.col("h"), F.col("s")).alias("f")).collect()]
    assert [round(x, 3) for x in got] == [1.0, 1.778, 1.0]
    assert df.select(editing.quality_warnings(F.col("w"), F.col("h"), F.lit(2.5)).alias("q")).collect()[2].q == ["unknown_source_size"]
    plans = spark.createDataFrame([(1, 5.0, 15.0, -8.0)], "candidate_id long, start double, end double, source_offset double")
    r = editing.source_range(plans).first()
    assert (r.media_start, r.media_end) == (0.0, 7.0)
    jobs = spark.createDataFrame([(1, "/a"), (2, "/b")], "candidate_id long, source_path string")
    earlier = spark.createDataFrame([(1, "/a", 1.0, 2.0), (2, "/old", 3.0, 4.0)], "candidate_id long, source_path string, start double, end double")
    assert {r.candidate_id: r.start for r in editing.reuse_bounds(jobs, earlier).collect()} == {1: 1.0, 2: None}


def test_proposals_are_held_within_the_rules(spark):
    decided = spark.createDataFrame([(1, 80.0, 110.0, 100.0, 103.0, 70.0, 130.0)], "candidate_id long, start double, end double, main_ts double, payoff_ts double, floor double, ceiling double")
    asked = spark.createDataFrame([(1, "105", None, 0.0, "x")], "candidate_id long, start string, end string, main_ts double, payoff_ts string")
    r = bounds.apply_proposal(decided, asked).first()
    # A main moment of 0.0 is a value: the start may not come after it, so it goes to the floor.
    # Forty seconds are within the ceiling, so the end stays.
    assert (r.start, r.main_ts, r.payoff_ts, r.end) == (70.0, 0.0, 103.0, 110.0)


def test_fingerprints_skip_unchanged_rows(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, path string, size long")
    done = store.changed_inputs(rows, rows.limit(0).select("id", F.lit("").alias("fingerprint")), ["id"], ["path", "size"]).select("id", "fingerprint")
    later = rows.withColumn("size", F.when(F.col("id") == 2, 7).otherwise(F.col("size")).cast("long"))
    assert [r.id for r in store.changed_inputs(later, done, ["id"], ["path", "size"]).collect()] == [2]


def test_probe_of_a_window(spark):
    said = spark.createDataFrame([("a", 1000.0 + t) for t in (100, 200, 300)], "k string, t double")
    loud = spark.createDataFrame([("a", 1000.0 + t, 1.0 if t in (107, 207, 307) else 0.0) for t in range(400)], "k string, t double, value double")
    assert alignment.probe(said, loud, ["k"], 1000.0, 400.0, 30.0).first().offset == 7.0
    df = spark.createDataFrame([(7.0, 0.9), (1.0, 0.9), (7.0, 0.01)], "o double, s double")
    assert [r.w for r in df.select(alignment.warning(F.col("o"), F.col("s"), 2.0).alias("w")).collect()] == ["timelines differ by +7.0s (score 0.90)", None, None]


def test_tiles_snap_to_seams_but_keep_the_face(spark):
    def frames(clip, seam):
        return [(clip, f, r, [190 if seam is not None and r >= seam else 90] * 32) for f in range(3) for r in range(64)]

    df = spark.createDataFrame(frames("seam", 40) + frames("flat", None) + frames("face", 40), "clip_id string, frame long, row long, values array<int>")
    box = (0.0, 0.0, 1.0, 45 / 64)
    boxes = spark.createDataFrame([(c, box) for c in ("seam", "flat", "face", "unseen")], "clip_id string, box struct<x:double,y:double,w:double,h:double>")
    faces = spark.createDataFrame([("face", 0.5, 43 / 64, 0.4, 0.1)], "clip_id string, x double, y double, width double, height double")
    got = {r.clip_id: (tuple(r.box), r.strength) for r in track.snap_to_seams(df, boxes, faces).collect()}
    assert got["seam"] == ((0.0, 0.0, 1.0, 40 / 64), 100.0)
    assert got["flat"] == got["face"] == got["unseen"] == (box, 0.0)


def test_a_derived_facecam_makes_a_clip_gaming(spark):
    points = spark.createDataFrame([("a", k, float(k), 0.82, 0.2, 0.08, 0.12) for k in range(6)], "clip_id string, seq long, t double, x double, y double, width double, height double")
    cam = "facecam struct<x:double,y:double,w:double,h:double>"
    clips = spark.createDataFrame([(c, q, 1920, 1080, 10.0, None, True) for c, q in (("a", "auto"), ("b", "auto"), ("c", "gaming"))], f"clip_id string, requested string, source_width int, source_height int, duration double, {cam}, facecam_auto boolean")
    out = layout.plan(clips, points)
    got = {r.clip_id: r for r in out["plans"].collect()}
    assert (got["a"].strategy, got["a"].facecam_source, got["a"].caption_prefer_top, got["a"].warnings) == ("gaming", "auto", True, ["facecam_box_auto", "upscale_exceeds_threshold"])
    assert len(out["segments"].filter("clip_id = 'a'").first().layers) == 2
    assert (got["b"].strategy, got["b"].facecam_source, got["b"].warnings) == ("irl", "", ["facecam_box_auto_failed"])
    assert (got["c"].strategy, set(got["c"].warnings)) == ("fit_blur", {"facecam_box_missing", "facecam_box_auto_failed"})
