"""Hand-made timelines: ties, gaps on the edge, and randomised comparison with plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import ChatRates, Settings
from tidemark.functions.times import MICROS
from tidemark.operators import fusion, rates, sequences
from tidemark.plans import detection

CHAT = [
    (12.0, "a", "hello"), (13.0, "b", "hi there"), (14.0, "c", "nice start"), (60.0, "d", "what is this"), (90.0, "e", "ok"),
    (120.0, "f", "WHAT"), (120.1, "g", "no way"), (120.2, "h", "omg"), (120.4, "i", "clip it"), (120.5, "j", "CLIP IT"),
    (120.6, "k", "insane"), (120.7, "l", "wow"), (120.9, "m", "clip that"), (121.0, "n", "lol"), (160.0, "o", "bye"), (170.0, "p", "gg"),
]


@pytest.fixture(scope="module")
def chat(spark):
    rows = [(1, k, round(t * MICROS), u, x) for k, (t, u, x) in enumerate(CHAT)]
    return spark.createDataFrame(rows, "stream_id long, seq long, us long, user string, text string")


def test_burst_and_keywords(chat):
    got = detection.chat_signals(chat, Settings(chat=ChatRates(keywords=("clip it", "clip that", "clip")))).orderBy("us", "kind").collect()
    assert [(r.us / 1e6, r.kind) for r in got] == [(14.0, "rate_spike"), (120.2, "rate_spike"), (120.4, "keyword")]


def test_candidates_carry_reasons(chat):
    got = detection.detect(chat).orderBy("source_ts").collect()
    assert [round(r.source_ts, 1) for r in got] == [14.0, 120.2]
    assert got[1].event_count == 2 and got[1].kinds == ["keyword", "rate_spike"]
    assert got[1].reason.startswith('Chat asked to clip it ("clip it" from i); Chat rate jumped')


def test_fused_with_levels(spark, chat):
    levels = [(1, k, k * 500_000, 0.5 if 236 <= k < 244 else 0.03) for k in range(400)]
    series = spark.createDataFrame(levels, "stream_id long, seq long, us long, value double")
    got = detection.detect(chat, series).orderBy(F.desc("score"), "source_ts").first()
    assert got.score == 1.0 and "chat_audio" in got.kinds and "louder" in got.reason


def test_peers_count_only_up_to_the_row(spark):
    df = spark.createDataFrame([("s", 0, 10), ("s", 1, 10), ("s", 2, 10), ("s", 3, 15)], "k string, seq long, us long")
    got = rates.window_counts(df, ["k"], 5, 10).orderBy("seq").collect()
    assert [r.window_count for r in got] == [1, 2, 3, 4]


def test_window_counts_across_parts(spark):
    rng = random.Random(5)
    times = sorted(rng.randrange(0, 5000) for _ in range(600))
    df = spark.createDataFrame([("s", k, t) for k, t in enumerate(times)], "k string, seq long, us long")
    got = {r.seq: (r.window_count, r.baseline_count) for r in rates.window_counts(df, ["k"], 20, 100, part=100).collect()}
    assert got == {k: tuple(sum(t - w <= u for u in times[: k + 1]) for w in (20, 100)) for k, t in enumerate(times)}


@pytest.mark.parametrize("seed", range(4))
def test_thinning_matches_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = sorted((rng.randrange(300), k) for k in range(60))
    want, last = [], None
    for t, k in rows:
        if last is None or t - last >= 7:
            want.append(k)
            last = t
    df = spark.createDataFrame([("s", t, k) for t, k in rows], "k string, us long, seq long")
    assert sorted(r.seq for r in sequences.thin(df, ["k"], 7).collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(4))
def test_dedupe_matches_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = sorted((rng.randrange(200), k, rng.randrange(4)) for k in range(60))
    held: list[tuple] = []
    for t, k, s in rows:
        if held and t - held[-1][0] < 6:
            if s > held[-1][2]:
                held[-1] = (t, k, s)
        else:
            held.append((t, k, s))
    df = spark.createDataFrame([("s", t, k, float(s)) for t, k, s in rows], "k string, us long, seq long, score double")
    assert sorted(r.seq for r in sequences.dedupe_nearby(df, ["k"], 6).collect()) == sorted(h[1] for h in held)


@pytest.mark.parametrize("seed", range(4))
def test_fusion_matches_a_loop(spark, seed):
    rng = random.Random(seed)
    a = sorted((rng.randrange(150), k) for k in range(25))
    b = sorted((rng.randrange(150), k) for k in range(25))
    used: set[int] = set()
    want = {}
    for t, k in a:
        best = None
        for u, j in b:
            if j not in used and abs(u - t) <= 5 and (best is None or abs(u - t) <= best[0]):
                best = (abs(u - t), j)
        want[k] = best[1] if best else None
        used |= {best[1]} if best else set()
    frame = lambda rows: spark.createDataFrame([("s", t, k, 0.5) for t, k in rows], "k string, us long, seq long, score double")
    got = fusion.fuse(frame(a), frame(b), ["k"], 5).collect()
    assert {r.first_seq: r.second_seq for r in got if r.first_seq is not None} == want
    assert sorted(r.second_seq for r in got if r.kind == "second") == sorted({j for _, j in b} - used)


def test_fusion_of_one_pair(spark):
    frame = lambda t, s: spark.createDataFrame([("s", t, 0, s)], "k string, us long, seq long, score double")
    got = fusion.fuse(frame(10, 0.7), frame(11, 0.75), ["k"], 5).collect()
    assert len(got) == 1 and got[0].kind == "pair" and got[0].score == 1.0


def test_sessions_merge_at_exactly_the_gap(spark):
    rows = [("s", 10, 0, 0.5, "a"), ("s", 15, 1, 0.9, "b"), ("s", 35, 2, 0.9, "c"), ("s", 56, 3, 0.4, "a")]
    df = spark.createDataFrame(rows, "k string, us long, seq long, score double, kind string")
    got = sequences.coalesce_sessions(df, ["k"], 20).orderBy("start_us").collect()
    assert [(r.start_us, r.end_us, r.peak_us, r.event_count) for r in got] == [(10, 35, 15, 3), (56, 56, 56, 1)]
    assert got[0].kinds == ["a", "b", "c"]


def test_rms_drops_the_partial_frame_and_keeps_a_short_series(spark):
    df = spark.createDataFrame([("a", k, 2.0) for k in range(7)] + [("b", 0, 3.0), ("b", 1, 4.0)], "k string, idx long, value double")
    got = {(r.k, r.frame): (r.t, round(r.rms, 6)) for r in rates.rms_frames(df, ["k"], 3, 1.0).collect()}
    assert got == {("a", 0): (0.5, 2.0), ("a", 1): (1.5, 2.0), ("b", 0): (0.0, round(12.5**0.5, 6))}


def test_histogram_clips_both_ends(spark):
    df = spark.createDataFrame([("a", t) for t in (-3.0, 0.5, 1.5, 99.0)], "k string, t double")
    got = {r.bin: r.level for r in rates.histogram(df, ["k"], F.col("t"), 1.0, 3).collect()}
    assert got == {0: 2.0, 1: 1.0, 2: 1.0}


def test_live_spikes_equal_batch(spark, tmp_path, chat):
    from tidemark.streaming import live

    source = tmp_path / "in"
    chat.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(chat.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    found = live.rate_spikes(stream, 5 * MICROS, 60 * MICROS, 3.0, 0.5, 1000 * MICROS)
    q = found.writeStream.format("memory").queryName("live_spikes").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    # Messages wait for later ones: nothing is due until the latest time is 1,000 s ahead.
    assert spark.table("live_spikes").count() == 0
    far = spark.createDataFrame([(1, 99, 5000 * MICROS, "z", "")], chat.schema)
    far.write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(chat.schema).parquet(str(source))
    q = live.rate_spikes(stream, 5 * MICROS, 60 * MICROS, 3.0, 0.5, 1000 * MICROS).writeStream.format("memory").queryName("live_spikes_2").outputMode("append").option("checkpointLocation", str(tmp_path / "state2")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = rates.rate_spikes(chat, ["stream_id"], 5 * MICROS, 60 * MICROS, 3.0, 0.5)
    assert sorted(r.seq for r in spark.table("live_spikes_2").collect()) == sorted(r.seq for r in batch.collect())


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Events of which several are of one instant, as a folder of tables and in DuckDB; ``rows(query)`` are the rows of both."""
    import duckdb

    from tidemark import queries

    rng = random.Random(11)
    values, us = [], 1704067200 * MICROS
    for k in range(400):
        us += int(rng.choice([20, 60, 400, 3000]) * MICROS)
        kind, value = rng.choice(["error", "error", "view", "click", "purchase"]), rng.choice([1.25, 2.5, 10.0, 90.0])
        values += [(n * 1000 + k, us, n * 10 + k % 7, kind, value) for n in range(rng.choice([1, 1, 3]))]
    con, at = duckdb.connect(), tmp_path_factory.mktemp("tied")
    con.execute("CREATE TABLE raw (event_id BIGINT, us BIGINT, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO raw VALUES (?, ?, ?, ?, ?)", values)
    con.execute("CREATE TABLE events AS SELECT event_id, make_timestamp(us) AS ts, user_id, event_type, value, '{}' AS props FROM raw")
    con.execute(f"COPY events TO '{at}/events.parquet' (FORMAT parquet)")

    def rows(name):
        df, ran = queries.QUERIES[name](spark, str(at)), con.execute(queries.ORACLE_SQL[name])
        return sorted(tuple(map(str, r)) for r in df.select(*(c[0] for c in ran.description)).collect()), sorted(tuple(map(str, r)) for r in ran.fetchall())

    return rows


@pytest.mark.parametrize("name", ["rate_window_counts", "rate_spikes", "rate_spikes_by_type", "stream_rate_spikes", "live_rate_spikes", "live_moments", "chat_signals", "ranked_moments"])
def test_rows_of_one_instant_count_as_in_sql(tied, name):
    got, want = tied(name)
    assert got == want and want


def test_counts_go_on_over_batches(spark):
    """Instants that lie in two batches of rows, parts of one baseline."""
    rng = random.Random(6)
    times = sorted(rng.randrange(0, 300) for _ in range(900))
    df = spark.createDataFrame([("s", k, t) for k, t in enumerate(times)], "k string, seq long, us long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        got = {r.seq: (r.window_count, r.baseline_count) for r in rates.window_counts(df, ["k"], 20, 100, part=100, peers=True).collect()}
    finally:
        spark.conf.set(key, was)
    assert got == {k: tuple(sum(t - w <= u <= t for u in times) for w in (20, 100)) for k, t in enumerate(times)}
