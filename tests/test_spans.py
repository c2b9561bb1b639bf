"""Interval algebra, dead air, bounds and cues on hand-made and random input."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import Bounds, ChatRates, Cues, DeadAir
from tidemark.operators import bounds, deadair, messages
from tidemark.operators import spans as sp

K = ["clip_id"]


def frame(spark, rows, clip="a"):
    return spark.createDataFrame([(clip, float(a), float(b)) for a, b in rows], "clip_id string, start double, end double")


def pairs(df):
    return sorted((r.start, r.end) for r in df.collect())


def test_merge_gap_is_inclusive(spark):
    assert pairs(sp.merge(frame(spark, [(0, 1), (1.5, 2), (2.6, 3), (5, 5)]), K, 0.5)) == [(0.0, 2.0), (2.6, 3.0)]
    assert pairs(sp.merge(frame(spark, [(-2, 1), (0, 4), (1, 2)]), K)) == [(0.0, 4.0)]


def test_gaps_have_head_and_tail(spark):
    ranges = spark.createDataFrame([("a", 0.0, 10.0), ("b", 0.0, 3.0)], "clip_id string, low double, high double")
    assert pairs(sp.gaps(frame(spark, [(2, 3), (8, 12)]), K, ranges)) == [(0.0, 2.0), (0.0, 3.0), (3.0, 8.0)]


@pytest.mark.parametrize("seed", range(3))
def test_subtract_matches_cells(spark, seed):
    rng = random.Random(seed)
    make = lambda n: [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(n))]
    a, b = make(6), make(6)
    whole = {x for s, e in a for x in range(s, e)} - {x for s, e in b for x in range(s, e)}
    got = sp.subtract(sp.merge(frame(spark, a), K), frame(spark, b), K, 10.0)
    assert {x for s, e in pairs(got) for x in range(int(s), int(e))} == whole


def test_shrink_drops_what_vanishes(spark):
    assert pairs(sp.shrink(frame(spark, [(0, 4), (6, 6.8)]), K, 0.5)) == [(0.5, 3.5)]


def plan(spark, silences, duration=10.0, protect=None, words=None, **cfg):
    clips = spark.createDataFrame([("a", duration)], "clip_id string, duration double")
    own = {k: None if v is None else frame(spark, v) for k, v in (("protect", protect), ("words", words))}
    got = deadair.plan(clips, frame(spark, silences), DeadAir(**cfg), own["words"], own["protect"])
    return got, got["summary"].first()


def test_dead_air_budget_keeps_the_shortest(spark):
    got, s = plan(spark, [(0, 3), (7, 10)], max_removed_ratio=0.4)
    assert s.applied and pairs(got["gaps"]) == [(7.2, 9.8)] and s.capped
    got, s = plan(spark, [(0, 3), (7, 10)], max_removed_ratio=0.9)
    assert pairs(got["keeps"]) == [(2.8, 7.2)] or pairs(got["gaps"]) == [(0.2, 2.8), (7.2, 9.8)]
    assert not s.capped


def test_dead_air_reasons(spark):
    assert plan(spark, [])[1].reason.startswith("no silence")
    assert plan(spark, [(2, 2.5)])[1].reason.startswith("every silent gap was too short")
    assert plan(spark, [(2, 5)], words=[(1.5, 6)])[1].reason.startswith("every silent gap contained speech")
    assert plan(spark, [(2, 5)], protect=[(1, 6)])[1].reason.startswith("the only silence")
    assert plan(spark, [(2, 5)], duration=0.0)[1].reason == "clip has no duration"
    assert plan(spark, [(2, 5)], enabled=False)[1].reason == "dead-air removal disabled"


def test_dead_air_speed(spark):
    got, s = plan(spark, [(2, 5)], mode="speed")
    assert round(s.removed_seconds, 4) == round(2.6 * (1 - 1 / 1.5), 4)
    parts = sorted((r.start, r.end, r.speed) for r in deadair.render_segments(got, DeadAir(mode="speed")).collect())
    assert parts == [(0.0, 2.2, 1.0), (2.2, 4.8, 1.5), (4.8, 10.0, 1.0)]


def candidate(spark):
    return spark.createDataFrame([(1, 100.0, 30.0, 30.0)], "candidate_id long, source_ts double, pre double, post double")


def evidence(spark, words=(), chat=(), levels=()):
    return (
        spark.createDataFrame([(1, *w) for w in words], "candidate_id long, start double, end double, text string"),
        spark.createDataFrame([(1, t) for t in chat], "candidate_id long, t double"),
        spark.createDataFrame([(1, *x) for x in levels], "candidate_id long, t double, value double"),
    )


def test_bounds_without_evidence_are_the_review_window(spark):
    r = bounds.decide(candidate(spark), *evidence(spark)).first()
    assert (r.start, r.end, r.method) == (77.5, 122.5, "review_window")


def test_bounds_from_chat_only(spark):
    r = bounds.decide(candidate(spark), *evidence(spark, chat=[95 + 0.5 * k for k in range(21)])).first()
    assert (r.start, r.end, r.method) == (73.0, 103.0, "signal_evidence")


def test_burst_and_decay(spark):
    c = candidate(spark)
    got = bounds.burst_end(c, evidence(spark, chat=[95 + 0.5 * k for k in range(13)])[1], ChatRates(window=5.0, min_rate=1.0), 6.0).first()
    assert got.burst_end >= 100.0
    levels = [(90.0 + k, v) for k, v in enumerate([0.02] * 10 + [0.3] * 5 + [0.028] * 6)]
    assert bounds.level_decay(c, evidence(spark, levels=levels)[2], 10.0, 0.02, 10.0).first().decay == 105.0


def test_constraints_in_order(spark):
    df = spark.createDataFrame([(1, 105.0, 104.0, 100.0, 103.0, 70.0, 130.0), (2, 70.0, 130.0, 100.0, 103.0, 70.0, 130.0)], "candidate_id long, start double, end double, main_ts double, payoff_ts double, floor double, ceiling double")
    got = {r.candidate_id: (r.start, r.end) for r in bounds.constrain(df, Bounds()).collect()}
    assert got[1] == (98.5, 108.5)
    assert got[2] == (85.0, 130.0)


def plain_cues(words, cfg):
    """The packing as a loop over all words."""
    cues, current = [], []
    for w in sorted(words):
        if current:
            text = " ".join(x[2] for x in [*current, w])
            if len(text) > cfg.max_chars * cfg.max_lines or w[1] - current[0][0] > cfg.max_seconds or w[0] - current[-1][1] >= cfg.pause or current[-1][2][-1] in ".!?…":
                cues.append(current)
                current = []
        current.append(w)
    cues.append(current)
    return [" ".join(x[2] for x in c) for c in cues]


@pytest.mark.parametrize("seed", range(3))
def test_cues_match_a_loop(spark, seed):
    rng = random.Random(seed)
    at, words = 0.0, []
    for _ in range(80):
        at += rng.choice([0.05, 0.1, 0.4])
        end = at + rng.choice([0.2, 0.5])
        words.append((round(at, 3), round(end, 3), rng.choice(["word", "a", "longer-word", "stop.", "why?"])))
        at = end
    df = spark.createDataFrame([("a", *w) for w in words], "clip_id string, start double, end double, text string")
    got = messages.cues(df, K).orderBy("cue").collect()
    assert [r.text for r in got] == plain_cues(words, Cues())
    assert all(a.end <= b.start + 1e-9 for a, b in zip(got, got[1:], strict=False))


def test_interpolated_words(spark):
    df = spark.createDataFrame([("a", 0.0, 3.0, " one  two three "), ("b", 0.0, 1.0, "  ")], "clip_id string, start double, end double, text string")
    assert [(r.text, r.start, r.end) for r in messages.interpolate_words(df, K).orderBy("seq").collect()] == [("one", 0.0, 1.0), ("two", 1.0, 2.0), ("three", 2.0, 3.0)]


def test_context_keeps_keywords(spark):
    said = [(1, k * 1_000_000, k, "u", "KEKW" if k % 2 else f"line {k}") for k in range(20)] + [(1, 30_000_000, 99, "v", "clip it")]
    m = spark.createDataFrame(said, "stream_id long, us long, seq long, user string, text string")
    moment = spark.createDataFrame([(7, 1, 10_000_000)], "moment_id long, stream_id long, us long")
    got = messages.context(moment, m, ["clip it"], 5)
    assert got["counts"].first()[1:] == (21, 5, 1)
    assert "clip it" in [r.text for r in got["messages"].collect()]
    assert [(r.text, r.n) for r in got["repeated"].collect()] == [("kekw", 10)]
    assert got["messages"].filter(F.col("text") == "KEKW").count() == 0


def uncovered(spans, blocks):
    out = []
    for start, end in spans:
        for a, b in sorted(blocks):
            if b > start and a < end:
                if a > start:
                    out.append((start, a))
                start = max(start, b)
        if end > start:
            out.append((start, end))
    return out


def joined(spans, gap):
    out = []
    for a, b in sorted((max(0, a), b) for a, b in spans if b > max(0, a)):
        if out and a - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_dead_air_sweep_matches_lists(spark, seed):
    rng = random.Random(seed)
    make = lambda n, size: [(a, a + rng.randrange(-1, size) / 4) for a in (rng.randrange(-8, 260) / 4 for _ in range(n))]
    silences, words, protect = make(40, 24), make(25, 6), make(4, 12)
    cfg = DeadAir(keep_pad=0.25, max_removed_ratio=0.2)
    heard = joined([(a, min(b, 60.0)) for a, b in silences], 0.25)
    rest = uncovered(uncovered(heard, joined(words, 0)), joined(protect, 0))
    long = [(a + 0.25, b - 0.25) for a, b in rest if b - a - 0.5 >= cfg.min_gap]
    cut, total = [], 0.0
    for a, b in sorted(long, key=lambda s: (round(s[1] - s[0], 3), -s[0])):
        total += b - a
        if total <= 12.0 + 1e-9:
            cut.append((a, b))
    got, s = plan(spark, silences, duration=60.0, protect=protect, words=words, keep_pad=0.25, max_removed_ratio=0.2)
    assert pairs(got["gaps"]) == sorted(cut) and s.n_gaps == len(cut) and s.capped == (len(cut) < len(long))
    shown = [x for x in uncovered([(0.0, 60.0)], cut) if x[1] - x[0] >= cfg.min_keep]
    assert pairs(got["keeps"]) == shown and abs(s.removed_seconds - (60.0 - sum(b - a for a, b in shown))) < 1e-9


def test_dead_air_of_a_clip_with_a_hundred_thousand_spans(spark):
    n = 100_000
    clips = spark.createDataFrame([("a", 10.0 * n)], "clip_id string, duration double")
    at = lambda a, b: spark.range(n).selectExpr("'a' AS clip_id", f"id * 10 + {a}D AS start", f"id * 10 + {b}D AS end")
    got = deadair.plan(clips, at(1, 4), DeadAir(max_removed_ratio=1.0), at(2, 2.1), at(6, 7))["summary"].first()
    assert (got.n_gaps, got.applied, got.capped) == (n, True, False)


def test_dead_air_ignores_spans_without_an_end(spark):
    rows = spark.createDataFrame([("a", 2.0, None), ("a", None, 4.0), ("a", 5.0, 8.0)], "clip_id string, start double, end double")
    clips = spark.createDataFrame([("a", 10.0), ("b", 5.0)], "clip_id string, duration double")
    got = deadair.plan(clips, rows, DeadAir())
    assert pairs(got["gaps"]) == [(5.2, 7.8)] and {(r.clip_id, r.applied) for r in got["summary"].collect()} == {("a", True), ("b", False)}
    assert deadair.plan(clips.limit(0), rows.limit(0), DeadAir())["summary"].collect() == []


def test_burst_end_counts_and_rounds_as_its_sql(spark, tmp_path):
    """Sums of doubles put the one event of user 1 within two hours before 2 h; that of user 2 is next to a half."""
    import duckdb

    from tidemark import queries

    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT *, 'a' AS event_type, 1.0::DOUBLE AS value FROM (VALUES (0, make_timestamp(1704067200000000 + 258793550908), 1), (1, make_timestamp(1704067200000000 + 128000500), 2)) t(event_id, ts, user_id)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = sorted(con.execute(queries.ORACLE_SQL["burst_end"]).fetchall())
    assert want[0][1] == 265993.551
    assert sorted(tuple(r) for r in queries.QUERIES["burst_end"](spark, str(tmp_path)).collect()) == want


def test_context_matches_a_loop(spark):
    """Ties in time, windows across parts and batches, streams, several caps."""
    rng = random.Random(4)
    said = [(s, rng.randrange(0, 900), k, "u", rng.choice(["clip it", "hello", "", "lol", None])) for k in range(700) for s in (rng.choice([1, 2]),)]
    asked = [(k, rng.choice([1, 2, 3]), rng.randrange(0, 900)) for k in range(60)]
    m = spark.createDataFrame(said, "stream_id long, us long, seq long, user string, text string")
    moment = spark.createDataFrame(asked, "moment_id long, stream_id long, us long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, 9)
    try:
        for cap, before, after in ((3, 10, 10), (40, 20, 31), (2, 0, 0)):
            got = messages.context(moment, m, ["clip it"], cap, before, after)
            rows, counts = {}, {}
            for k, stream, at in asked:
                inside = [x for x in said if x[0] == stream and at - before <= x[1] <= at + after]
                spoken = sorted((x[4] != "clip it", abs(x[1] - at - (after - before) / 2), x[1], x[2]) for x in inside if x[4] in ("clip it", "hello"))[:cap]
                rows[k], counts[k] = [(x[2], x[3]) for x in spoken], (len(inside), len(spoken), sum(not x[0] for x in spoken))
            shown = {}
            for r in got["messages"].collect():
                shown.setdefault(r.moment_id, []).append((r.us, r.seq))
            assert {k: sorted(v) for k, v in shown.items()} == {k: sorted(v) for k, v in rows.items() if v}
            assert {r.moment_id: (r.window_count, r.shown, r.keyword_hits) for r in got["counts"].collect()} == counts
    finally:
        spark.conf.set(key, was)
