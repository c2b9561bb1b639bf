"""Byte ranges of sample files, chat files of all shapes, faces by squares, dense numbers, spans of long keys."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import Faces, Layout
from tidemark.operators import sequences, track
from tidemark.sources import chat, samples


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    place = tmp_path_factory.mktemp("pcm")
    values = np.random.default_rng(1).random(200_003).astype("<f4")
    (place / "a.pcm").write_bytes(values.tobytes() + b"xy")  # a part of a sample at the end
    (place / "b.pcm").write_bytes(values[:10].tobytes())
    (place / "empty.pcm").write_bytes(b"")
    return place, values


def test_samples_are_read_by_ranges(spark, raw):
    place, values = raw
    df = samples.read_samples(spark, str(place / "a.pcm"), 8000, byte_range=100_000)
    assert df.rdd.getNumPartitions() == 9
    got = df.orderBy("idx").toPandas()
    assert (got["idx"].to_numpy() == np.arange(len(values))).all() and (got["value"].to_numpy() == values).all()
    per_file = {r["file"].rsplit("/", 1)[1]: r["count"] for r in samples.read_samples(spark, str(place), 8000).groupBy("file").count().collect()}
    assert per_file == {"a.pcm": 200_003, "b.pcm": 10}


def test_a_window_of_samples_reads_its_bytes_only(spark, raw):
    place, values = raw
    options = {"path": str(place / "a.pcm"), "rate": "8000", "start": "2.5", "duration": "1.25", "range": "20000"}
    ranges = samples.SampleReader(options).partitions()
    assert (ranges[0].start, ranges[-1].stop) == (4 * 20_000, 4 * 30_000) and all(r.stop - r.start <= 20_000 for r in ranges)
    got = samples.read_samples(spark, options["path"], 8000, 2.5, 1.25).orderBy("idx").toPandas()
    assert got["idx"].iloc[0] == 20_000 and (got["value"].to_numpy() == values[20_000:30_000]).all()
    assert samples.read_samples(spark, options["path"], 8000, 900.0, 1.0).count() == 0
    with pytest.raises(ValueError):
        samples.SampleReader({"path": "x", "start": "1"})


def test_chat_files_of_all_shapes(spark, tmp_path):
    messages = [{"ts": 2.5, "user": "a", "text": "x\ny", "emotes": ["K"]}, {"ts": 1.0, "user": "b", "text": "", "emotes": None}]
    shapes = {
        "list": json.dumps(messages, indent=1), "lines": "\n".join(map(json.dumps, messages)) + "\n", "one": json.dumps(messages[0], indent=2), "comments": json.dumps({"comments": messages}), "nothing": " \n", "none": "[]",
    }
    for name, text in shapes.items():
        (tmp_path / f"{name}.json").write_text(text)
    got: dict = {}
    for r in chat.read_chat_json(spark, str(tmp_path)).orderBy("seq").collect():
        got.setdefault(r["file"].rsplit("/", 1)[1].removesuffix(".json"), []).append((r["ts"], r["user"], r["text"], r["emotes"]))
    both = [(2.5, "a", "x\ny", ["K"]), (1.0, "b", "", None)]
    assert got == {"list": both, "lines": both, "comments": both, "one": both[:1]}


def clusters(boxes, cfg):
    last, out = [], []
    for frame, _, x, y, w, h in sorted((f, -w * h, x, y, w, h) for f, x, y, w, h in boxes):
        cx, cy, area, best = x + w / 2, y + h / 2, w * h, None
        for k, (lx, ly, size, _) in enumerate(last):
            d = math.hypot(cx - lx, cy - ly)
            if d <= cfg.link_distance and (size <= 0 or size / cfg.area_ratio <= area <= size * cfg.area_ratio) and (best is None or d < best[0]):
                best = (d, k)
        if best is None:
            last.append(None)
            best = (0, len(last) - 1)
        elif last[best[1]][3] == frame:
            continue
        last[best[1]] = (cx, cy, area, frame)
        out.append((frame, best[1], x, y))
    return out


def test_faces_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    cfg = Faces(link_distance=0.1, area_ratio=2.0)
    rows = [("a", f, round(rng.random() * 1.5 - 0.2, 2), round(rng.random(), 2), *rng.choice([(0.1, 0.1), (0.1, 0.12), (0.3, 0.3), (0.0, 0.1)])) for f in range(40) for _ in range(rng.randrange(12))]
    rows += [("b", 0, 0.1, 0.1, 0.1, 0.1), ("b", 0, 0.1, 0.1, 0.1, 0.1), ("b", None, 0.1, 0.1, 0.1, 0.1)]
    got = track.face_clusters(spark.createDataFrame(rows, "clip_id string, frame long, x double, y double, w double, h double").repartition(3), cfg).collect()
    assert sorted((r["frame"], r["cluster"], r["x"], r["y"]) for r in got if r["clip_id"] == "a") == sorted(clusters([r[1:] for r in rows if r[0] == "a"], cfg))
    assert [r["cluster"] for r in got if r["clip_id"] == "b"] == [0]


def test_a_thousand_faces_in_a_clip(spark):
    boxes = spark.range(1000).crossJoin(spark.range(20).withColumnRenamed("id", "frame")).select(F.lit("a").alias("clip_id"), "frame", (F.col("id") % 40).cast("double").alias("x"), F.floor(F.col("id") / 40).cast("double").alias("y"), F.lit(0.1).alias("w"), F.lit(0.1).alias("h"))
    assert track.face_clusters(boxes).groupBy("cluster").count().filter("count = 20").count() == 1000


def test_spans_of_a_key_with_many_points(spark):
    n = 300_000
    points = spark.range(n).select(F.lit("a").alias("clip_id"), F.col("id").alias("seq"), F.col("id").cast("double").alias("t"), (F.col("id") % 2 * 0.5 + F.floor(F.col("id") / 1000) % 2 * 0.1).alias("x"), F.lit(float(n)).alias("duration"))
    got = track.steady_spans(points, ["clip_id"], cfg=Layout(max_segments=24)).orderBy("start").collect()
    assert len(got) == 24 and got[0]["start"] == 0.0 and got[-1]["end"] == n


@pytest.mark.parametrize("blocks", [1, 8])
def test_dense_numbers(spark, blocks):
    rows = [(k % 7, f"n{k * 7919 % 1000:04}") for k in range(1000)]
    got = sequences.numbered(spark.createDataFrame(rows, "a long, b string").repartition(5), ["a", "b"], blocks=blocks).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["number"])] == sorted(rows) and {r["number"] for r in got} == set(range(1, 1001))
