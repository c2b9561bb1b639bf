"""Near duplicates against all pairs: a large group of near copies, ids that name several texts, no squared growth."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from tidemark.llm import minhash


def shingles(t: str, width: int) -> frozenset:
    w = t.encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()


def truth(rows: list[tuple[int, str]], width: int) -> dict[int, int]:
    """Smallest reachable doc_id of each doc_id, by counting what every pair of texts shares."""
    sets = [shingles(t, width) for _, t in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    shared: Counter = Counter()
    for own in holders.values():
        shared.update((a, b) for i, a in enumerate(own) for b in own[i + 1 :])
    root = {i: i for i, _ in rows}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(rows[a][0]), find(rows[b][0])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    base, passage = [word() for _ in range(150)], [word() for _ in range(70)]
    out = []
    for _ in range(500):  # copies of one text with 0 to 14 words changed: some link to each other only
        own = list(base)
        for at in rng.sample(range(150), rng.randrange(15)):
            own[at] = word()
        out.append(" ".join(own))
    out += [" ".join(passage + [word() for _ in range(rng.randrange(30, 90))]) for _ in range(700)]  # a long shared passage, no copies
    for _ in range(100):  # pairs on both sides of the threshold
        own = [word() for _ in range(rng.randrange(3, 120))]
        out.append(" ".join(own))
        for at in rng.sample(range(len(own)), min(len(own), rng.randrange(4))):
            own[at] = word()
        out.append(" ".join(own))
    out += [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(1000)]
    ids = rng.sample(range(10_000), len(out))
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize("width", [4, 5])
def test_all_links_are_found_without_all_pairs(spark, rows, width, monkeypatch):
    asked = []
    plain = minhash.verified

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(minhash, "verified", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = truth(rows, width)
    assert len(set(want.values())) < len(rows) - 150
    assert {r.doc_id: r.component_id for r in minhash.near_components(df, width).collect()} == want
    assert len(asked) == 3 and sum(asked) < 20 * len(rows)


def test_an_id_with_several_texts_keeps_all_links(spark):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(200))
    rows = [(1, words(0)), (1, words(1)), (2, words(0) + " more"), (3, words(1) + " more"), (9, words(2)), (9, words(3)), (7, words(2) + " more"), (8, words(4)), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_components(df).collect())
    assert got == [(1, 196, 1, True), (1, 196, 1, True), (2, 197, 1, False), (3, 197, 1, False), (7, 197, 7, True), (8, 196, 8, True), (9, 0, 9, True), (9, 196, 7, False), (9, 196, 7, False)]


def test_prefix_pairs_lose_nothing(spark, rows):
    some = rows[:160] + rows[1200:1300]
    sets = [sorted(hash(x) >> 1 for x in shingles(t, 5)) for _, t in some]
    full = spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>")
    known = minhash.profiles(full, full.select("node"), (4, 5))
    placed = known.withColumn("comp", known["node"])
    got = {(r.a, r.b) for r in minhash.prefix_pairs(placed, placed, (4, 5)).collect()}
    own = [set(s) for s in sets]
    want = {(a, b) for b in range(len(own)) for a in range(b) if 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])}
    assert want and want <= got


def skewless(spark, make):
    """Rows read by the tasks of each shuffled stage while ``make`` runs, with nothing broadcast and small thresholds: the largest share of one task."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return make()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_line_of_half_of_all_documents_is_split(spark, monkeypatch):
    from tidemark.llm import lines
    from tidemark.llm.common import Scratch

    line = "a line that is long enough to be counted as boilerplate"
    docs = spark.range(30_000).selectExpr("id AS doc_id", f"concat('own ', id, ' line that is long enough to be counted here', IF(id % 2 = 0, '\\n{line}', '')) AS text").repartition(12)

    def tasks():
        gone = lines.frequent_lines(docs, Scratch(spark, "test"))
        return gone.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()

    found = skewless(spark, tasks)
    most = max(r["count"] for r in found)
    assert sum(r["count"] for r in found) == 14_999 and most < 14_999 / 4, most  # pieces are as large as the other partitions, in bytes
    monkeypatch.setattr(lines, "MOST_BROADCAST", 10)
    by_shuffle = {tuple(r) for r in lines.drop_lines(docs).collect()}
    monkeypatch.undo()
    assert by_shuffle == {tuple(r) for r in lines.drop_lines(docs).collect()}
