"""Substring de-duplication: passages of ``WINDOW`` words that an earlier document holds are removed, by super-k-mers.

1.  Slots of word hashes that the corpus fills far above the average are found
    in one scan.  They only order minimisers, rare ones first, so that a window
    with any word of its own is keyed by that and not by a common passage.
2.  Each window's minimiser is the first, in that order, of its runs of
    ``SEED_WORDS`` words.  Consecutive windows of one minimiser form a
    super-k-mer.  One row a document lists its minimisers and where they begin.
3.  Minimisers are counted: those of one document only are done with.  The others
    are set back to their documents, and only these texts are read again.
4.  Each super-k-mer that is left travels as one packed string (its words, joined
    by spaces) to the bucket of its minimiser; a task sends equal strings once,
    with the smallest doc_id.  Minimisers met more than ``MOST_MET`` times send
    their windows one by one to buckets of the windows' own hashes, so no bucket
    holds more than that many strings, whatever a passage's share of all rows.
5.  In the bucket windows are sorted by hash, equal neighbours are compared word
    by word, and each run of equal windows gets its smallest doc_id.  The answer
    for a packed string goes back to the documents that sent it, by its digest.
6.  Words under a window whose smallest doc_id is below the document's own go.

Defined results: a null text has no words; fewer words than a window lose none; a
null doc_id is smaller than any other; rows of one doc_id never remove words of
each other, and rows repeated as a whole are treated alike; very long texts
count whole; columns other than id and text are ignored, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, kept, map_batches, small_batches, texts_of
from tidemark.llm.shingles import Words, mix

WINDOW = 50  #: words of a window
SEED_WORDS = 8  #: words of a minimiser
SLOTS = 1 << 20  #: counters of seeds
HOT_SLOT = 8  #: a slot is hot from so many times the average on; there are at most SLOTS / HOT_SLOT of them
LEAST_HOT = 64  #: and from so many seeds on
MOST_MET = 4096  #: a minimiser met more often sends single windows
MOST_BROADCAST = 1 << 20
BATCH_WORDS = 200_000  #: words of buckets that are sorted at once
FIRST = -(1 << 63)  #: stands for a null doc_id

_U = np.uint64
_STEP = np.array([xxhash.xxh64_intdigest(b"place", k) | 1 for k in range(SEED_WORDS)], np.uint64)
_BASE = _U(0x9E3779B97F4A7C15)  #: odd, so it has an inverse
_BASE_BACK = _U(pow(int(_BASE), -1, 1 << 64))


def _words_of(texts: list[str]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text, all their hashes in one array, and where each text begins (with the end)."""
    known = kept("shingle words", Words)
    own = [t.encode("utf-8").split() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(w) for w in own])]).astype(np.int64)
    hashes = np.fromiter((known[x] for w in own for x in w), np.uint64, int(starts[-1]))
    return own, hashes, starts


def _seeds(hashes: np.ndarray) -> np.ndarray:
    """A hash of each run of ``SEED_WORDS`` hashes."""
    n = max(0, len(hashes) - SEED_WORDS + 1)
    total = np.zeros(n, np.uint64)
    for k in range(SEED_WORDS if n else 0):
        total += mix(hashes[k : k + n] ^ _STEP[k]) * _STEP[k]
    return mix(total)


def _slots(seeds: np.ndarray) -> np.ndarray:
    return (seeds >> _U(64 - 20)).astype(np.int64)


def _inside(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Of ``n`` places, whether ``width`` words from there lie in one text."""
    place = np.arange(n)
    end = starts[1:][np.searchsorted(starts[1:], place, "right").clip(max=len(starts) - 2)]
    return place + width <= end


def hot_slots(texts: DataFrame) -> np.ndarray:
    """log2 of how far each slot stands above the average (0: not hot); of the rows of ``texts`` (doc_id, text).

    Partitions report the slots that stand out in them, and how many seeds they
    have; no more than ``SLOTS`` rows come to the driver, whatever the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            _, hashes, starts = _words_of(batch.column("text").to_pylist())
            seeds = _seeds(hashes)
            if len(seeds):
                total += np.bincount(_slots(seeds[_inside(starts, SEED_WORDS, len(seeds))]), minlength=SLOTS)
        n = int(total.sum())
        if n:
            out = np.flatnonzero(total >= max(4, HOT_SLOT // 2 * n / SLOTS))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(out, -1)), pa.array(np.append(total[out], n))], names=["slot", "n"])

    small_batches(texts.sparkSession)
    counts = texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    rows = counts.filter((F.col("slot") < 0) | (F.col("n") >= LEAST_HOT)).toArrow()
    slot, n = rows.column("slot").to_numpy(), rows.column("n").to_numpy()
    least = max(float(LEAST_HOT), n[slot < 0].sum() * (HOT_SLOT / SLOTS))
    hot = (slot >= 0) & (n >= least)
    heat = np.zeros(SLOTS, np.uint8)
    heat[slot[hot]] = 1 + np.log2(n[hot] / least).clip(0, 14).astype(np.uint8)
    return heat


def minimisers(hashes: np.ndarray, heat: np.ndarray) -> np.ndarray:
    """The least seed of each window, in the order of heat and then hash (as 64 bits of both)."""
    seeds = _seeds(hashes)
    order = (heat[_slots(seeds)].astype(np.uint64) << _U(60)) | (mix(seeds) >> _U(4))
    span, have = WINDOW - SEED_WORDS + 1, 1
    while have * 2 <= span:
        order = np.minimum(order[:-have], order[have:])
        have *= 2
    rest = span - have
    return np.minimum(order[: len(order) - rest], order[rest:]) if rest else order


def _minimisers_of_texts(hashes: np.ndarray, starts: np.ndarray, heat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text: the minimiser of each super-k-mer and its first window."""
    least = minimisers(hashes, heat) if len(hashes) >= WINDOW else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        own = least[a : max(a, b - WINDOW + 1)]
        at = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        out.append((own[at].view(np.int64), at.astype(np.int32)))
    return out


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def window_hashes(ids: np.ndarray) -> np.ndarray:
    """A hash of each window of word ids, by differences of prefix sums."""
    n = len(ids)
    power = np.full(n + 1, _BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(n + 1, _BASE_BACK)
    back[0] = 1
    back = np.multiply.accumulate(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + _U(1)) * power[:n], dtype=np.uint64)])
    return mix((sums[WINDOW:] - sums[:-WINDOW]) * back[: n - WINDOW + 1])


def least_holders(packed: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each packed string, the smallest doc of each of its windows over all the strings (exact)."""
    ids: dict[bytes, int] = {}
    own = [p.split(b" ") for p in packed]
    lengths = np.array([len(w) for w in own])
    flat = np.fromiter((ids.setdefault(x, len(ids)) for w in own for x in w), np.int64, int(lengths.sum()))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    real = np.flatnonzero(_inside(starts, WINDOW, len(flat) - WINDOW + 1))
    of = np.searchsorted(starts, real, "right") - 1
    hashes = window_hashes(flat)[real]
    order = np.argsort(hashes, kind="stable")
    at, sorted_docs = real[order], docs[of[order]]
    same = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
    new = np.ones(len(order), bool)
    new[same + 1] = False
    differ = np.zeros(len(same), bool)
    for k in range(WINDOW):
        differ |= flat[at[same] + k] != flat[at[same + 1] + k]
    if differ.any():  # two windows of one hash: told apart by their words
        first: dict[bytes, int] = {}
        group = np.array([first.setdefault(flat[x : x + WINDOW].tobytes(), len(first)) for x in at])
        order2 = np.argsort(group, kind="stable")
        order, at, sorted_docs = order[order2], at[order2], sorted_docs[order2]
        new = np.append(True, group[order2][1:] != group[order2][:-1])
    runs = np.flatnonzero(new)
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(sorted_docs, runs), np.diff(np.append(runs, len(order))))
    ends = np.searchsorted(of, np.arange(len(packed)), "right")
    return np.split(least, ends[:-1])


def _spans(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal values: where they begin, with the end; the values."""
    at = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return np.append(at, len(least)).astype(np.int32), least[at]


def _super_kmers(words: list[bytes], at: list[int], ends: list[int], hot: list[bool]) -> Iterator[tuple[int, bytes, bool]]:
    """(first window, packed string, hot) of the super-k-mers at ``at``; those of hot minimisers fall into their windows."""
    for a, e, h in zip(at, ends, hot, strict=True):
        if h:
            for k in range(a, e):
                yield k, b" ".join(words[k : k + WINDOW]), True
        else:
            yield a, b" ".join(words[a : e + WINDOW - 1]), False


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by spaces)."""
    return _decided(docs, id_col, text_col, "sha")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, text (the words that stay, joined by spaces)."""
    return _decided(docs, id_col, text_col, "text")


def _decided(docs: DataFrame, id_col: str, text_col: str, give: str) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "repeats")
    # Rows of equal id and text are treated alike, so these two name a row.
    texts = texts_of(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(FIRST)).alias("doc"), "text", F.col("doc_id").isNull().alias("unnamed")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    heat = spark.sparkContext.broadcast(hot_slots(texts.select("doc", "text")))
    column, form = ("kept_sha256", lambda x: hashlib.sha256(x).hexdigest()) if give == "sha" else ("kept", lambda x: x.decode("utf-8"))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, hashes, starts = _words_of(batch.column("text").to_pylist())
        marks = _minimisers_of_texts(hashes, starts, heat.value)
        n = np.diff(starts)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("unnamed"), batch.column("sha"), pa.array(n), pa.array([form(b" ".join(w)) for w in own]), pa.array([m for m, _ in marks], pa.list_(pa.int64())), pa.array([a for _, a in marks], pa.list_(pa.int32()))],
            names=["doc", "unnamed", "sha", "n_words", column, "mini", "at"],
        )

    rows = scratch.save(map_batches(texts, scan, f"doc long, unnamed boolean, sha binary, n_words long, {column} string, mini array<long>, at array<int>"))
    listed = rows.filter(F.size("mini") > 0)
    marks = listed.select("doc", "sha", (F.col("n_words") - WINDOW + 1).cast("int").alias("windows"), "at", F.posexplode("mini").alias("k", "mini"))
    several = marks.groupBy("mini").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("met")).filter("low < high")
    # Written first, so that the join can split a minimiser that many rows have.
    shared = scratch.save(several.select("mini", (F.col("met") > MOST_MET).alias("hot")))
    placed = marks.select("doc", "sha", "mini", F.element_at("at", F.col("k") + 1).alias("a"), F.coalesce(F.try_element_at("at", F.col("k") + 2), "windows").alias("e"))
    found = placed.join(shared, "mini").groupBy("doc", "sha").agg(F.array_sort(F.collect_set(F.struct("a", "e", "mini", "hot"))).alias("parts"))
    found = scratch.save(found)
    # Only texts that have a part left are shuffled; their names are broadcast while they are few, as 8 bytes each.
    name = F.xxhash64("doc", "sha")
    named = found.select(name.alias("name")).distinct()
    wanted = texts.join(F.broadcast(named), name == F.col("name"), "left_semi") if found.count() <= MOST_BROADCAST else texts
    suspects = scratch.save(wanted.select("doc", "sha", "text").join(found, ["doc", "sha"]))

    def each(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[bytes], list[dict]]]:
        for doc, sha, text, parts in zip(*(batch.column(c).to_pylist() for c in ("doc", "sha", "text", "parts")), strict=True):
            yield doc, sha, text.encode("utf-8").split(), parts

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        for batch in batches:
            buckets, packed, docs = [], [], []
            for doc, _, words, parts in each(batch):
                for p in parts:
                    for _, string, alone in _super_kmers(words, [p["a"]], [p["e"]], [p["hot"]]):
                        d = _digest(string)
                        if sent.get(d, doc + 1) <= doc:
                            continue
                        if len(sent) >= 1 << 18:
                            sent.clear()
                        sent[d] = doc
                        buckets.append(int.from_bytes(d[:8], "little", signed=True) if alone else p["mini"])
                        packed.append(string)
                        docs.append(doc)
            yield from _limited(pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(packed, pa.binary()), pa.array(docs, pa.int64())], names=["bucket", "packed", "doc"]))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(strings: dict[bytes, int]) -> pa.RecordBatch:
            packed = list(strings)
            spans = [_spans(x) for x in least_holders(packed, np.fromiter(strings.values(), np.int64, len(strings)))]
            return pa.RecordBatch.from_arrays([pa.array([_digest(p) for p in packed], pa.binary()), pa.array([a for a, _ in spans], pa.list_(pa.int32())), pa.array([v for _, v in spans], pa.list_(pa.int64()))], names=["digest", "edges", "least"])

        strings: dict[bytes, int] = {}
        size, last = 0, None
        for batch in batches:
            for bucket, packed, doc in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != last and size >= BATCH_WORDS:  # equal windows lie in one bucket
                    yield answer(strings)
                    strings, size = {}, 0
                last = bucket
                if packed not in strings:
                    size += packed.count(b" ") + 1
                strings[packed] = min(doc, strings.get(packed, doc))
        if strings:
            yield answer(strings)

    packed = suspects.mapInArrow(send, "bucket long, packed binary, doc long")
    answers = scratch.save(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(decide, "digest binary, edges array<int>, least array<long>"))

    def recall(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, shas, at, digests = [], [], [], []
        for doc, sha, words, parts in each(batch):
            for p in parts:
                for a, string, _ in _super_kmers(words, [p["a"]], [p["e"]], [p["hot"]]):
                    docs.append(doc)
                    shas.append(sha)
                    at.append(a)
                    digests.append(_digest(string))
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(shas, pa.binary()), pa.array(at, pa.int32()), pa.array(digests, pa.binary())], names=["doc", "sha", "a", "digest"])

    asked = map_batches(suspects, recall, "doc long, sha binary, a int, digest binary")
    told = asked.join(answers, "digest").select("doc", "sha", "a", F.posexplode("least").alias("k", "least"), "edges").filter("least < doc")
    told = told.select("doc", "sha", F.struct((F.col("a") + F.element_at("edges", F.col("k") + 1)).alias("a"), (F.col("a") + F.element_at("edges", F.col("k") + 2) + WINDOW - 1).alias("e")).alias("span"))
    gone = told.groupBy("doc", "sha").agg(F.array_sort(F.collect_set("span")).alias("gone"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, out = [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            words, stay, at, lost = text.encode("utf-8").split(), [], 0, 0
            for s in spans:
                if s["a"] > at:
                    stay += words[at : s["a"]]
                lost += max(0, s["e"] - max(at, s["a"]))
                at = max(at, s["e"])
            stay += words[at:]
            removed.append(lost)
            out.append(form(b" ".join(stay)))
        return pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("sha"), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=["doc", "sha", "n_removed", "rest"])

    # Repeated rows have one decision; written first, so that the join can split a hot name.
    changed = scratch.save(map_batches(suspects.dropDuplicates(["doc", "sha"]).select("doc", "sha", "text").join(gone, ["doc", "sha"]), cut, "doc long, sha binary, n_removed long, rest string"))
    scratch.keep_only(rows, changed)
    out = rows.select("doc", "unnamed", "sha", "n_words", column).join(changed, ["doc", "sha"], "left")
    return out.select(
        F.when(~F.col("unnamed"), F.col("doc")).alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("rest", column).alias("kept_sha256" if give == "sha" else "text")
    )


def _limited(batch: pa.RecordBatch, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)
