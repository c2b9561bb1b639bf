"""Exact de-duplication by exchange of Golomb-coded fingerprints.

1.  One scan: every partition hashes its texts to fingerprints of
    ``log2(rows) + EXTRA`` bits, sorts the distinct ones, and sends each owner
    (a range of fingerprints) the gaps between them, Golomb-Rice coded, and a
    bit for each that the partition itself holds more than once.
2.  Owners decode the lists, find fingerprints that several partitions hold,
    and return to each sender a bitmap of its list.
3.  Senders set the bitmaps against their rows.  Rows that no bit marks are
    unique; the others are suspects, some of them by chance.
4.  Only the texts of suspects are shuffled: they are grouped by their bytes
    (after partial aggregation where they lie), so copies are verified exactly.

A fingerprint that a third of all rows share is sent once by each partition, and
its texts meet as one partial row of each partition, so no task gathers copies.
The few groups that can be so large are joined back by broadcast.

Defined results: a null text counts as empty; a null doc_id is smaller than any
other; of repeated rows with equal doc_id and text just one stays, whichever;
very long texts count whole; an empty table gives an empty result; columns other
than id and text are ignored here and returned as they are by ``keep_first``,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, private, small_batches, texts_of

EXTRA = 12  #: bits of a fingerprint beyond log2 of the rows; one row in 2**EXTRA is suspected by chance
SEED = 42  #: of xxhash64, as Spark's own function has it
#: Suspected fingerprints are broadcast up to this many (8 bytes each); beyond it they are joined by a shuffle.
MOST_BROADCAST = 1 << 20
HOT_GROUPS = 1024  #: groups of more than this part of all rows are joined by broadcast; there are no more of them than this
OWN_ROWS = 1 << 18  #: fingerprints an owner is meant to hold


def golomb_encode(values: np.ndarray, low: int, k: int) -> bytes:
    """Sorted distinct values from ``low`` on: quotients of the gaps in unary, remainders in ``k`` bits."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=low - 1).astype(np.int64) - 1
    quotient = gaps >> k
    ends = np.cumsum(quotient + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8).reshape(-1)
    head = len(unary).to_bytes(8, "little")
    return head + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(code: bytes, n: int, low: int, k: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    m = int.from_bytes(code[:8], "little")
    data = np.frombuffer(code, np.uint8, offset=8)
    unary = np.unpackbits(data[: (m + 7) // 8], count=m)
    ends = np.flatnonzero(unary) + 1
    quotient = np.diff(ends, prepend=0) - 1
    rest = np.unpackbits(data[(m + 7) // 8 :], count=n * k).reshape(n, k).astype(np.int64) if k else np.zeros((n, 0), np.int64)
    gaps = (quotient << k) + (rest << np.arange(k - 1, -1, -1)).sum(axis=1)
    return np.cumsum(gaps + 1) + low - 1


def _rice(span: int, n: int) -> int:
    """The best number of remainder bits for ``n`` values spread over ``span``."""
    return max(0, int(math.log2(max(1.0, span / max(1, n) * math.log(2)))))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "dedup")
    texts = texts_of(docs, id_col, text_col)
    rows = max(1, docs.count())
    bits = min(62, max(20, math.ceil(math.log2(rows)) + EXTRA))
    owner_bits = max(3, math.ceil(math.log2(max(1, rows / OWN_ROWS))))
    span = 1 << (bits - owner_bits)

    def send(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ["message", "part", "row", "doc_id", "finger", "sha", "owner", "n", "code"]
        seen, at = [], 0
        for batch in batches:
            raw = [x.encode("utf-8") for x in batch.column(1).to_pylist()]
            n = len(raw)
            fingers = np.array([xxhash.xxh64_intdigest(x, SEED) for x in raw], np.uint64) >> np.uint64(64 - bits) if n else np.zeros(0, np.uint64)
            fingers = fingers.astype(np.int64)
            seen.append(fingers)
            shas = pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())
            none = pa.nulls(n, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), batch.column(0), pa.array(fingers), shas, none, none, pa.nulls(n, pa.binary())], names=names)
            at += n
        if at:
            values, counts = np.unique(np.concatenate(seen), return_counts=True)
            owners = values >> (bits - owner_bits)
            out = []
            for owner in np.unique(owners):
                a, b = np.searchsorted(owners, [owner, owner + 1])
                own = values[a:b]
                k = _rice(span, len(own))
                out.append((int(owner), len(own), bytes([k]) + golomb_encode(own, int(owner) * span, k) + np.packbits(counts[a:b] > 1).tobytes()))
            m = len(out)
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, bool)), pa.array(np.full(m, part, np.int32)), none, none, none, pa.nulls(m, pa.binary()), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True))], names=names)

    sent = scratch.save(texts.mapInArrow(send, "message boolean, part int, row long, doc_id long, finger long, sha binary, owner int, n int, code binary"), ["message"])
    own_rows = sent.filter(~F.col("message")).select("part", "row", "doc_id", "finger", "sha")
    messages = sent.filter("message").select("part", "owner", "n", "code")

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        owner = int(frame["owner"].iloc[0])
        lists, local = [], []
        for n, code in zip(frame["n"], frame["code"], strict=True):
            tail = (n + 7) // 8
            lists.append(golomb_decode(code[1 : len(code) - tail], n, owner * span, code[0]))
            local.append(np.unpackbits(np.frombuffer(code[len(code) - tail :], np.uint8), count=n).astype(bool))
        whole = np.concatenate(lists)
        values, counts = np.unique(whole, return_counts=True)
        marks = (counts[np.searchsorted(values, whole)] > 1) | np.concatenate(local)
        ends = np.cumsum([len(x) for x in lists])
        return pd.DataFrame({"part": frame["part"], "owner": owner, "bitmap": [np.packbits(marks[e - len(x) : e]).tobytes() for e, x in zip(ends, lists, strict=True)]})

    bitmaps = messages.groupBy("owner").applyInPandas(decide, "part int, owner int, bitmap binary")

    def mark(key, mine: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        fingers = mine["finger"].to_numpy(np.int64)
        values = np.unique(fingers)
        owners = values >> (bits - owner_bits)
        marked = np.zeros(len(values), bool)
        by = defaultdict(bytes, zip(maps["owner"], maps["bitmap"], strict=True))
        for owner in np.unique(owners):
            a, b = np.searchsorted(owners, [owner, owner + 1])
            marked[a:b] = np.unpackbits(np.frombuffer(by[owner], np.uint8), count=b - a)
        return pd.DataFrame({"part": mine["part"], "row": mine["row"], "doc_id": mine["doc_id"].astype("Int64"), "finger": mine["finger"], "sha": mine["sha"], "suspect": marked[np.searchsorted(values, fingers)]})

    marked = scratch.save(own_rows.groupBy("part").cogroup(bitmaps.groupBy("part")).applyInPandas(mark, "part int, row long, doc_id long, finger long, sha binary, suspect boolean"))
    scratch.keep_only(marked)
    suspects, clear = marked.filter("suspect"), marked.filter(~F.col("suspect"))

    wanted = suspects.select("finger").distinct()
    number = wanted.count()
    finger = F.shiftrightunsigned(F.xxhash64("text"), 64 - bits)
    side = F.broadcast(wanted) if number <= MOST_BROADCAST else wanted
    verified = texts.withColumn("finger", finger).join(side, "finger", "left_semi").groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = verified.select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size")
    # Of the rows with the largest doc_id, the first one met stays.
    first = suspects.groupBy("sha").agg(F.max_by(F.struct("part", "row"), F.struct("doc_id", -F.col("part"), -F.col("row"))).alias("stays"), F.count("*").alias("seen"))
    groups = groups.join(first, "sha").withColumn("group_size", F.when(F.col("seen") == F.col("group_size"), F.col("group_size")).otherwise(F.raise_error(F.lit("texts of one SHA-256 differ, or rows changed between scans")).cast("long")))
    groups = scratch.save(groups.select("sha", "keep_id", "group_size", "stays"))
    # At most HOT_GROUPS groups can hold more than that share of the rows: they are broadcast, so no task gathers their rows.
    is_hot = F.col("group_size") > rows // HOT_GROUPS
    hot = F.broadcast(groups.filter(is_hot))
    of_groups = suspects.join(hot, "sha").unionByName(suspects.join(hot, "sha", "left_anti").join(groups.filter(~is_hot), "sha"))
    named = F.lower(F.hex("sha")).alias("text_sha256")
    of_groups = of_groups.select("doc_id", "keep_id", "group_size", (F.struct("part", "row") == F.col("stays")).alias("kept"), named)
    single = clear.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), named)
    return single.unionByName(of_groups)


def drop_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the ids in ``gone`` (doc_id), which are broadcast up to ``MOST_BROADCAST`` and shuffled beyond."""
    other = private(docs, "gone")
    gone = gone.select(F.col("doc_id").alias(other))
    few = gone.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col].cast("long").eqNullSafe(gone[other]), "left_anti")


def keep_first(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns.

    A row is told by its doc_id and the digest of its text (null as empty), as
    null or repeated ids may name several texts.  Of rows repeated with both
    alike one stays; only such rows are shuffled whole.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    sha, gone_id, gone_sha = (private(docs, x) for x in ("sha", "gone_id", "gone_sha"))
    again = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    dropped = scratch.save(decided.filter(~F.col("kept")).select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha), again.alias("again")).distinct())
    known = docs.withColumn(sha, F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256))

    def meet(rows: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
        few = pairs.count() <= MOST_BROADCAST // 4
        return rows.join(F.broadcast(pairs) if few else pairs, rows[id_col].cast("long").eqNullSafe(pairs[gone_id]) & (rows[sha] == pairs[gone_sha]), how)

    repeated, gone = dropped.filter("again").drop("again"), dropped.filter("NOT again").drop("again")
    out = meet(known, gone, "left_anti")
    if repeated.limit(1).count():
        out = meet(out, repeated, "left_anti").unionByName(meet(out, repeated, "left_semi").dropDuplicates([id_col, sha]))
    return out.select(docs.columns)
