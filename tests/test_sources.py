"""Readers, writers, logs, store logs, text functions and layouts on small hand-made input."""

from __future__ import annotations

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.config import Faces, Layout
from tidemark.functions import geometry as g
from tidemark.functions import text as tx
from tidemark.operators import alignment, layout, metadata, store, track
from tidemark.operators.reasons import extract_reason
from tidemark.plans import editing
from tidemark.queries.common import rounded
from tidemark.sources import chat, documents, media


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}")


def value(spark, column, v, kind="string"):
    return one(spark, v, kind).select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("shape", ["list", "messages", "comments"])
def test_chat_json_shapes(spark, tmp_path, shape):
    items = [
        {"ts": 0, "user": "a", "text": "hi"}, {"offset_seconds": 3.5, "username": "b", "body": "yo", "emotes": ["x"]},
        {"contentOffsetSeconds": 4, "commenter": {"display_name": "C"}, "message": {"body": "nested"}}, {"ts": 9, "user": "", "username": "d", "text": "", "body": "later"}, {"ts": 10},
    ]
    (tmp_path / "chat.json").write_text(json.dumps(items if shape == "list" else {shape: items}, indent=1))
    got = chat.read_chat_json(spark, str(tmp_path / "chat.json")).orderBy("seq").collect()
    assert [(r.ts, r.user, r.text) for r in got] == [(0.0, "a", "hi"), (3.5, "b", "yo"), (4.0, "C", "nested"), (9.0, "d", "later"), (10.0, "unknown", "")]
    assert got[1].emotes == ["x"] and got[0].emotes is None


def test_chat_json_without_a_time(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"text": "x"}, {"ts": 1, "text": "y"}]')
    with pytest.raises(Exception, match="without a time"):
        chat.read_chat_json(spark, str(tmp_path / "c.json")).collect()
    assert [r.text for r in chat.read_chat_json(spark, str(tmp_path / "c.json"), strict=False).collect()] == ["y"]
    (tmp_path / "d.json").write_text('{"other": 1}')
    with pytest.raises(Exception, match="neither a list"):
        chat.read_chat_json(spark, str(tmp_path / "d.json")).collect()


def test_chat_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1.5, "a", "hi", ["k"]), (2.0, "b", "yo", None)], "ts double, user string, text string, emotes array<string>")
    chat.write_chat_json(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_line_protocol(spark):
    lines = spark.createDataFrame([(105.0, "@badges=;id=1 :ann!ann@host PRIVMSG #room :hello : there"), (106.0, ":bob!b@h PRIVMSG #room :"), (107.0, "PING :server"), (108.0, ":x JOIN #room"), (109.0, "garbage")], "received double, value string")
    got = chat.parse_lines(lines, origin=F.lit(100.0)).orderBy("ts").collect()
    assert [(r.ts, r.user, r.text) for r in got] == [(5.0, "ann", "hello : there"), (6.0, "bob", "")]


def test_socket_source(spark):
    import socket
    import threading

    from tidemark.sources.lines import LineReader

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        link, _ = server.accept()
        link.sendall(b":a!a@h PRIVMSG #r :one\r\nPING :x\r\n:b!b@h PRIVMSG #r :tw")
        assert link.recv(100).startswith(b"PONG")
        link.sendall(b"o\r\n")
        link.close()

    thread = threading.Thread(target=serve, daemon=True)
    thread.start()
    reader = LineReader({"host": "127.0.0.1", "port": str(server.getsockname()[1]), "wait": "1"})
    offset, seen = reader.initialOffset(), []
    for _ in range(5):
        rows, end = reader.read(offset)
        own = list(rows)
        assert list(reader.readBetweenOffsets(offset, end)) == own
        seen += own
        offset = end
        if len(seen) == 2:
            break
    assert [text for _, text in seen] == [":a!a@h PRIVMSG #r :one", ":b!b@h PRIVMSG #r :two"]
    server.close()


def test_silence_log(spark):
    lines = ["[x] silence_start: -0.01", "[x] silence_end: 2.5 | silence_duration: 2.51", "noise", "[x] silence_start: 7"]
    df = spark.createDataFrame([("a", k, x, 10.0) for k, x in enumerate(lines)], "clip string, seq long, value string, duration double")
    assert [(r.start, r.end) for r in media.parse_silences(df, ["clip"], end_hint="duration").orderBy("start").collect()] == [(0.0, 2.5), (7.0, 10.0)]
    assert [(r.start, r.end) for r in media.parse_silences(df, ["clip"]).collect()] == [(0.0, 2.5)]


def test_loudness_log(spark):
    log = 'x {"a": 1} y {"input_i": "-20.5", "kind": "dynamic"} {broken {"input_i": "-18.0", "target": 1}'
    df = spark.createDataFrame([(log,), ("nothing",)], "text string")
    got = [r.loudness for r in media.loudness(df).collect()]
    assert got == [{"input_i": -18.0, "target": 1.0}, None]


def test_pcm_and_files(spark, tmp_path):
    np.arange(10, dtype="<f4").tofile(tmp_path / "a.raw")
    got = media.read_pcm(spark, str(tmp_path / "a.raw"), 2, 1.0, 2.0).orderBy("idx").collect()
    assert [(r.idx, r.value) for r in got] == [(0, 2.0), (1, 3.0), (2, 4.0), (3, 5.0)]
    listed = media.files(spark, str(tmp_path))
    assert media.within_budget(listed, 40).first().fits is False and media.within_budget(listed, 41).first().fits is True


def test_prune_oldest_first(spark):
    rows = [("d", f"f{k}", 10, k, k == 0) for k in range(5)]
    df = spark.createDataFrame(rows, "dir string, path string, size long, modified long, kept boolean")
    assert sorted(r.path for r in media.prune_plan(df, ["dir"], 25, "kept").collect()) == ["f1", "f2", "f3"]
    assert media.prune_plan(df, ["dir"], 0).count() == 0


def test_documents_are_tolerant(spark):
    rows = spark.createDataFrame([(1.23456, [0.9999], None)], "a double, b array<double>, c string")
    text = rows.select(documents.to_documents(rows).alias("value")).first().value
    assert json.loads(text) == {"a": 1.235, "b": [1.0], "c": None}
    docs = spark.createDataFrame([(text,), ("{broken",), ("{}",)], "value string")
    got = documents.from_documents(docs, "a double, c string", {"a": 7.0, "c": "x"}).collect()
    assert [tuple(r) for r in got] == [(1.235, "x"), (7.0, "x"), (7.0, "x")]


def test_subtitles(spark):
    words = [(0.0, 0.5, "Hi"), (0.5, 1.001, "{you}")]
    cues = spark.createDataFrame([("a", 1, 0.0, 1.001, "Hi {you}", words)], "clip string, cue long, start double, end double, text string, words array<struct<start:double,end:double,text:string>>")
    doc = documents.subtitle_documents(cues, ["clip"])
    line = doc.first().document.splitlines()[-1]
    assert line == "Dialogue: 0,0:00:00.00,0:00:01.00,Main,{\\k50}HI {\\k50}(YOU)"
    assert documents.subtitle_preview(doc, ["clip"]).first().lines == ["HI (YOU)"]


def test_export_has_fixed_columns(spark, tmp_path):
    documents.export_csv(spark.createDataFrame([(1, "approved", "x")], "review_id long, decision string, signals string"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == list(store.EXPORT_COLUMNS)


def test_keywords_stand_alone(spark):
    first = lambda c: tx.first_keyword(c, ["clip it", "clip"])
    assert [value(spark, first, t) for t in ("clippers are winning", "unclipped vod", "please CLIP it", "éclip it", "clip!", None)] == [None, None, "clip it", None, "clip", None]


def test_text_functions(spark):
    assert value(spark, tx.is_emote_only, "KEKW!!") and value(spark, tx.is_emote_only, " ") and value(spark, tx.is_emote_only, "??")
    assert not value(spark, tx.is_emote_only, "kekw nice") and not value(spark, tx.is_emote_only, "ok")
    assert value(spark, tx.hashtag, " ##My-Tag é") == "mytag" and value(spark, tx.hashtag_unicode, "#Été 1") == "été1"
    assert value(spark, tx.strip_quotes, '"hi"') == "hi" and value(spark, tx.strip_quotes, '"hi') == '"hi'
    assert value(spark, tx.word_forms, "Insane, it's [CRAZY]!") == ["insane", "it's", "crazy"]
    assert value(spark, tx.json_object_text, 'x {"a": 1} y') == '{"a": 1}' and value(spark, tx.json_object_text, "{a") == "{}"
    assert value(spark, tx.video_url, "123") == "https://www.twitch.tv/videos/123" and value(spark, tx.video_url, "chan") == "https://www.twitch.tv/chan"
    assert value(spark, tx.recording_name, "videos/12 3/") == "12_3.ts"
    assert value(spark, tx.format_selector, "720p60") == "bv*[height<=720]+ba/b[height<=720]" and value(spark, tx.format_selector, "best") == "bv*+ba/b"
    assert value(spark, tx.downloader_name, "YT-DLP") == "yt_dlp" and value(spark, tx.downloader_name, "curl") is None
    assert value(spark, tx.rational, "30000/1001") == 29.97 and value(spark, tx.rational, "1/0") is None
    assert value(spark, tx.ass_time, 3661.239, "double") == "1:01:01.24"
    assert value(spark, lambda c: tx.first_sentences(c, 1), "One. Two!") == "One."


def test_reasons(spark):
    says = lambda text: value(spark, extract_reason, text)
    assert says(None) == "Flagged by detection signals"
    assert says('{"kind":"keyword","keyword":"clip it","user":"ann"}') == 'Chat asked to clip it ("clip it" from ann)'
    assert says('{"events":[{"kind":"chat_audio","chat":{"kind":"rate_spike","window_rate":1.0,"baseline_rate":0.25},"audio":{"kind":"intensity_spike","multiplier":3}}]}') == "Chat rate jumped 4.0x vs the last minute; Audio got 3.0x louder than the recent baseline"
    assert says('{"kinds":["rate_spike"]}') == "Chat rate jumped vs the last minute"
    assert says('{"kinds":["zeta","beta_ray"]}') == "Flagged by beta ray signal"


def test_revisions(spark):
    log = [(1, 7, "plan", "ok"), (2, 7, "rough", "ok"), (3, 7, "final", "ok"), (4, 7, "final", "ok"), (5, 7, "final", "failed")]
    got = {r.id: (r.revision, r.is_current) for r in store.revisions(spark.createDataFrame(log, "id long, candidate_id long, kind string, status string")).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (3, False), 4: (4, True), 5: (5, False)}


def test_reviews_mirror_status(spark):
    c = spark.createDataFrame([(1, "pending"), (2, "pending")], "id long, status string")
    r = spark.createDataFrame([(1, 1, "approved", "boring"), (2, 1, "rejected", "boring"), (3, 2, "rejected", "no such")], "id long, candidate_id long, decision string, reason_code string")
    got, bad = store.record_review(c, r)
    assert {x.id: x.status for x in got.collect()} == {1: "rejected", 2: "pending"} and [x.id for x in bad.collect()] == [3]


def test_columns_are_added(spark):
    df = spark.createDataFrame([(1, None)], "id long, caption string")
    assert tuple(store.add_columns(df, {"caption": ("string", ""), "edit_status": ("string", "unrendered"), "path": ("string", None)}).first()) == (1, "", "unrendered", None)


def test_metadata(spark):
    clips = spark.createDataFrame([(1, "", "What a clutch round! Really. Third.", "clutch clutch ace", "Ann")], "clip_id long, caption string, transcript string, chat_text string, login string")
    r = metadata.fallback(clips, ["clutch", "unsaid"]).first()
    assert r.title == "What a clutch round!" and r.description == "What a clutch round! Really. (via Ann)" and r.hashtags[:2] == ["ann", "clutch"] and "unsaid" not in r.hashtags
    p = spark.createDataFrame([(1, '"T"', "d", ["#Clutch", "#nowhere"]), (1, "x", "d", ["#nowhere"])], "clip_id long, title string, description string, hashtags array<string>")
    got = {x.title: (x.hashtags, x.problem) for x in metadata.validate(p, clips).collect()}
    assert got == {"T": (["clutch"], None), "x": ([], "no supported hashtag")}


def test_layouts(spark):
    clips = spark.createDataFrame([(1, "auto", 1920, 1080, 10.0, None), (2, "auto", 640, 360, 10.0, None), (3, "auto", 1920, 1080, 10.0, (0.7, 0.7, 0.25, 0.25)), (4, "gaming", 1920, 1080, 10.0, None)], "clip_id long, requested string, source_width int, source_height int, duration double, facecam struct<x:double,y:double,w:double,h:double>")
    points = spark.createDataFrame([(1, k, k / 2, 0.2 if k < 10 else 0.8, 0.9, 0.0, 0.0) for k in range(20)], "clip_id long, seq long, t double, x double, y double, width double, height double")
    got = layout.plan(clips, points)
    plans = {r.clip_id: r for r in got["plans"].collect()}
    assert [plans[k].strategy for k in (1, 2, 3, 4)] == ["irl", "fit_blur", "gaming", "fit_blur"]
    assert plans[2].warnings == ["low_resolution_layout"] and plans[4].warnings == ["facecam_box_missing"] and plans[3].caption_prefer_top
    assert plans[1].bottom_coverage == 1.0 and "caption_band_moved" in plans[1].warnings and round(plans[1].upscale_factor, 2) == 1.78
    assert [(r.start, r.end, r.crop_x) for r in got["segments"].filter("clip_id = 1").orderBy("start").collect()] == [(0.0, 5.0, 0.2), (5.0, 10.0, 0.8)]
    assert layout.caption_bands(54.0) == {"bottom": (1525.0, 1660.0), "top": (260.0, 395.0)}


def test_capped_spans_merge_the_least_change(spark):
    points = spark.createDataFrame([("a", k, float(k), 0.5 + 0.3 * (-1) ** k * (1 + k / 100), 80.0) for k in range(80)], "clip_id string, seq long, t double, x double, duration double")
    got = track.steady_spans(points, ["clip_id"], cfg=Layout()).orderBy("start").collect()
    assert len(got) == 24 and got[0].start == 0.0 and got[-1].end == 80.0
    assert all(a.end == b.start for a, b in zip(got, got[1:], strict=False))


def test_faces(spark):
    steady = [("a", k, 0.6 + k / 500, 0.2, 0.2, 0.2) for k in range(12)]
    passing = [("a", k, 0.1, 0.1, 0.1, 0.1) for k in (3, 4)]
    boxes = spark.createDataFrame(steady + passing, "clip_id string, frame long, x double, y double, w double, h double")
    frames = spark.createDataFrame([("a", 15)], "clip_id string, total_frames long")
    got = track.face_track(boxes, frames, 1.0, Faces()).orderBy("seq").collect()
    assert len(got) == 15 and round(got[0].x, 3) == 0.7 and got[14].x == got[11].x and got[0].width == 0.2
    assert track.face_vote(track.face_clusters(boxes), frames, Faces(min_hits=13)).count() == 0


def test_seam(spark):
    rows = [("a", f, r, [90 if r < 6 else 190] * 4) for f in range(3) for r in range(12)]
    df = spark.createDataFrame(rows, "clip_id string, frame long, row long, values array<int>")
    assert track.strongest_seam(df, 1, 11).first().row == 6
    assert track.strongest_seam(df, 7, 11).count() == 0


def test_centroid_and_motion(spark):
    p = spark.createDataFrame([("a", k, float(k == 9)) for k in range(10)], "clip_id string, place long, energy double")
    assert round(track.centroid(p, ["clip_id"]).first().center, 4) == 0.7925
    frames = spark.createDataFrame([("a", 0, [[0, 0], [0, 0]]), ("a", 1, [[0, 4], [0, 0]])], "clip_id string, frame long, pixels array<array<int>>")
    got = {(r.axis, r.place): r.energy for r in track.motion_profiles(frames).collect()}
    assert got == {("x", 0): 0.0, ("x", 1): 4.0, ("y", 0): 4.0, ("y", 1): 0.0}
    path = track.motion_track(track.motion_profiles(frames), ["clip_id"], 2.0).first()
    assert path.x > 0.5 > path.y and path.t == 0.75


def test_motion_tracks_round_as_their_sql(spark, tmp_path):
    """Rows differ by 3 and 5 in two quarters: y is 0.5203125, whose double times a million lies below the half."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT * FROM (VALUES (0, TIMESTAMP '2024-01-01 00:30:00', 1, 'a', 0.0::DOUBLE), (1, TIMESTAMP '2024-01-02 06:30:00', 1, 'a', 3.2), (2, TIMESTAMP '2024-01-02 12:30:00', 1, 'a', 5.9)) t(event_id, ts, user_id, event_type, value)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = con.execute(queries.ORACLE_SQL["motion_tracks"]).fetchall()
    assert [r[3] for r in want] == [0.520312]
    assert [tuple(r) for r in queries.QUERIES["motion_tracks"](spark, str(tmp_path)).collect()] == want


def test_rounded_as_duckdb_rounds(spark):
    values = [0.5203125, 0.7094374999999999, 0.0000005, 1.0000005, -0.5203125, 2.5, 0.0, 12345.6789015, None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v"), 6).alias("r")).collect()
    assert [r.r for r in got] == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]


def test_geometry(spark):
    df = spark.createDataFrame([(1920.0, 1080.0)], "w double, h double")
    r = df.select(g.crop_inside(g.frame(F.col("w"), F.col("h")), F.lit(9 / 16), 0.9, 0.5).alias("c"), g.parse_box(F.lit("0.1, 0.2,0.3 ,0.4")).alias("b"), g.parse_box(F.lit("auto")).alias("n")).first()
    assert tuple(r.c) == (1920 - 607.5, 0.0, 607.5, 1080.0) and tuple(r.b) == (0.1, 0.2, 0.3, 0.4) and r.n is None


def test_alignment(spark):
    said = spark.createDataFrame([("a", t) for t in (100.0, 200.0, 300.0)], "k string, t double")
    loud = spark.createDataFrame([("a", float(t), 1.0 if t in (95, 195, 295) else 0.0) for t in range(400)], "k string, t double, value double")
    r = alignment.timeline_offset(said, loud, ["k"], 1.0, 400, 60, F.col("value")).first()
    assert r.offset == -5.0 and r.score > 0.9
    few = alignment.timeline_offset(said.limit(2), loud, ["k"], 1.0, 400, 60, F.col("value")).first()
    assert (few.offset, few.score) == (0.0, 0.0)
    rng = np.random.default_rng(5)
    wide = rng.random(2000)
    assert alignment.sliding_correlation(wide, wide[700:1300])[0] == 700
    assert alignment.sliding_correlation(wide[:10], wide) == (0, 0.0) and alignment.sliding_correlation(wide, np.ones(50)) == (0, 0.0)


def test_service_failures_stay_apart(spark):
    def answer(text):
        if text == "bad":
            raise RuntimeError("down")
        return text.upper()

    df = spark.createDataFrame([(1, "a"), (2, "bad")], "id long, request string")
    got = {r.id: (r.answer, r.error) for r in editing.call_service(df, "id", "request", answer).collect()}
    assert got == {1: ("A", None), 2: (None, "RuntimeError: down")}
    assert editing.call_service(df, "id", "request", answer, 0).count() == 0
