"""Matching and nearest samples against plain loops: ties, shared instants, nulls, carried columns, growth."""

from __future__ import annotations

import random
import time

import pytest

from tidemark.operators import fusion


def matched(first, second, reach):
    out, used, second = [], set(), sorted(second)
    for us, seq, score in sorted(first):
        best = None
        for k, (other, _, _) in enumerate(second):
            if k not in used and abs(other - us) <= reach and (best is None or abs(other - us) <= best[0]):
                best = (abs(other - us), k)
        if best is None:
            out.append((us, "first", score, seq, None))
        else:
            used.add(best[1])
            out.append((us, "pair", min(1.0, score + 0.5 * second[best[1]][2]), seq, second[best[1]][1]))
    return out + [(us, "second", score, None, seq) for k, (us, seq, score) in enumerate(second) if k not in used]


@pytest.mark.parametrize("span", [150, 1500, 9000])
def test_fuse(spark, span):
    rng = random.Random(span)
    first = [(rng.randrange(span), k, round(rng.random(), 3)) for k in range(300)]
    second = [(rng.randrange(span), 1000 + k, round(rng.random(), 3)) for k in range(300)]
    a, b = (spark.createDataFrame([(*r, f"n{r[1]}") for r in x], "us long, seq long, score double, name string").repartition(3) for x in (first, second))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")  # a run goes over many batches
    try:
        got = fusion.fuse(a, b, [], 10, first_also=["name"], second_also=["name"], blocks=4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert sorted(((r["us"], r["kind"], r["score"], r["first_seq"], r["second_seq"]) for r in got), key=str) == sorted(matched(first, second, 10), key=str)
    for r in got:
        assert r["first_name"] == (None if r["first_seq"] is None else f"n{r['first_seq']}")
        assert r["second_name"] == (None if r["second_seq"] is None else f"n{r['second_seq']}")


def test_fuse_keeps_rows_without_time_and_empty_sides(spark):
    a = spark.createDataFrame([("k", None, 1, 0.5), ("k", 5, 2, None), (None, 5, 3, 0.1)], "k string, us long, seq long, score double")
    b = spark.createDataFrame([("k", 7, 9, 0.4), (None, 6, 8, 0.2)], "k string, us long, seq long, score double")
    got = {(r["k"], r["kind"], r["first_seq"], r["second_seq"], r["score"]) for r in fusion.fuse(a, b, ["k"], 10).collect()}
    assert got == {("k", "first", 1, None, 0.5), ("k", "pair", 2, 9, 0.2), (None, "pair", 3, 8, 0.2)}
    assert {r["kind"] for r in fusion.fuse(a, b.limit(0), ["k"], 10).collect()} == {"first"}
    assert fusion.fuse(a.limit(0), b.limit(0), ["k"], 10).collect() == []


def test_fuse_takes_time_in_proportion(spark):
    def seconds(n: int) -> float:
        a = spark.range(n).selectExpr("id * 3 AS us", "id AS seq", "0.5D AS score")
        b = spark.range(n).selectExpr("id * 3 + 1 AS us", "id AS seq", "0.5D AS score")
        began = time.perf_counter()
        assert fusion.fuse(a, b, [], n).count() == n
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(32_000) < 8 * seconds(8_000)  # a scan of all partners in reach would take 16 times


@pytest.mark.parametrize("blocks", [1, 7])
def test_nearest_sample(spark, blocks):
    rng = random.Random(8)
    times = [(rng.choice("ab"), rng.randrange(5000)) for _ in range(400)] + [("none", 5), ("a", None)]
    samples = [(rng.choice("ab"), rng.randrange(2000, 2600), k) for k in range(60)] + [("a", 4999, 99), ("other", 3, 1), ("b", None, 5)]
    found = fusion.nearest_sample(spark.createDataFrame(times, "k string, us long"), spark.createDataFrame(samples, "k string, us long, value long"), ["k"], blocks=blocks)
    want = {}
    for k, us in times:
        near = [(abs(s - us), s, v) for key, s, v in samples if us is not None and s is not None and key == k]
        if near:
            want[k, us] = min(near)
    assert {(r["k"], r["us"]): (r["distance"], r["sample_us"], r["value"]) for r in found.collect()} == want
