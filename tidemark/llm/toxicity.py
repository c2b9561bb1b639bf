"""Toxicity by a factorization machine over hashed terms.

A document is the set of its lower-cased words and of their beginnings of four,
five and six characters, hashed into ``2**BITS`` buckets.  The score is

    sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>)

so a pair of terms (an insult and the mention of a group) can weigh more than
both alone.  Weights are fitted by AdaGrad on a bounded, hash-ordered sample of
the labelled rows (``max_rows``), each class filling at most half of it beyond
what the other leaves free; w0 is then moved by the log of the sampling odds, so
scores follow the share of toxic rows among all labelled rows at every size;
scoring reads every document.

Terms that say nothing get no weight, so long clean documents do not gather
noise.  A term is kept if it tells the classes apart alone (chi-square of
``LEAST_CHI``; of more than ``MOST_TERMS`` such terms the best), or in company:
all pairs of the ``PAIRED_TERMS`` most frequent terms are counted in the sample,
whatever their labels, and both terms of a pair are kept that tells the classes
apart by ``LEAST_PAIR_CHI`` more than either alone.

Defined results: null and empty texts score sigmoid(w0); very long texts are
read whole; repeated rows score alike, and are learned from once: of an id with
several texts the smallest is; several labels of one document count as toxic if
any is; null labels and ids are left out; without labelled rows of both classes
every score is the share of toxic rows (0 without rows); an empty table gives an
empty column; columns other than those named are never read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, kept, map_batches, texts_of

BITS = 20
PREFIXES = (4, 5, 6)
STRIP = ".,;:!?\"'()[]{}<>*#&%$-_"
LEAST_CHI = 20.0
MOST_TERMS = 8192
LEAST_PAIR_CHI = 40.0
PAIRED_TERMS = 1024
FACTORS = 4
THRESHOLD = 0.3


def terms(word: str) -> tuple[int, ...]:
    """Hashed terms of one lower-cased word."""
    word = word.strip(STRIP)
    if not word:
        return ()
    mask = (1 << BITS) - 1
    return (zlib.crc32(b"w" + word.encode()) & mask, *(zlib.crc32(b"p%d" % n + word[:n].encode()) & mask for n in PREFIXES if len(word) >= n))


def document_terms(text: str) -> np.ndarray:
    """The distinct hashed terms of a whole text."""
    found: set[int] = set()
    for word in set(text.lower().split()):
        found.update(terms(word))
    return np.fromiter(found, np.int32, len(found))


@dataclass(frozen=True)
class Machine:
    """Weights of a fitted factorization machine; ``buckets`` names the terms that have any."""

    bias: float
    buckets: np.ndarray
    linear: np.ndarray
    factors: np.ndarray
    key: str

    def margin(self, index: list[int]) -> float:
        if not index:
            return self.bias
        v = self.factors[index]
        s = v.sum(axis=0)
        return float(self.bias + self.linear[index].sum() + 0.5 * (s @ s - (v * v).sum()))

    def scorer(self):
        """A function from texts to scores that keeps the terms of words it has met, within a bound."""
        where = {int(b): k for k, b in enumerate(self.buckets)}
        cache: dict[str, tuple[int, ...]] = {}

        def score(text: str) -> float:
            found: set[int] = set()
            for word in set(text.lower().split()):
                own = cache.get(word)
                if own is None:
                    own = tuple(where[t] for t in terms(word) if t in where)
                    if len(word) <= 48:
                        if len(cache) >= 400_000:
                            cache.clear()
                        cache[word] = own
                if own:
                    found.update(own)
            return float(1.0 / (1.0 + np.exp(-np.clip(self.margin(sorted(found)), -40, 40))))

        return score


def train(rows: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, epochs: int = 40, rate: float = 0.15, decay: float = 1e-5, batch: int = 256, seed: int = 7) -> Machine:
    """Fit on rows of indices into ``buckets``."""
    rng, n, k = np.random.default_rng(seed), len(rows), FACTORS
    share = float(labels.mean()) if n else 0.0
    key = f"{zlib.crc32(buckets.tobytes()):08x}{n}{int(labels.sum()) if n else 0}"
    if n == 0 or share in (0.0, 1.0):
        bias = 40.0 if share == 1.0 else -40.0
        return Machine(bias, np.zeros(0, np.int32), np.zeros(0), np.zeros((0, k)), key)
    bias = float(np.log(share / (1 - share)))
    w, v = np.zeros(len(buckets)), rng.normal(0, 0.01, (len(buckets), k))
    gb, gw, gv = 1e-6, np.full(len(w), 1e-6), np.full(v.shape, 1e-6)
    sizes = np.array([len(r) for r in rows])
    for _ in range(epochs):
        order = rng.permutation(n)
        for start in range(0, n, batch):
            own = order[start : start + batch]
            size, y = sizes[own], labels[own]
            flat = np.concatenate([rows[i] for i in own]) if size.sum() else np.zeros(0, np.int64)
            at = np.repeat(np.arange(len(own)), size)
            vf = v[flat]
            s = np.zeros((len(own), k))
            q = np.zeros((len(own), k))
            for f in range(k):
                s[:, f] = np.bincount(at, vf[:, f], len(own))
                q[:, f] = np.bincount(at, vf[:, f] ** 2, len(own))
            z = bias + np.bincount(at, w[flat], len(own)) + 0.5 * (s * s - q).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(own)
            db = g.sum()
            gb += db * db
            bias -= rate * db / np.sqrt(gb)
            dw = np.bincount(flat, g[at], len(w)) + decay * w
            gw += dw * dw
            w -= rate * dw / np.sqrt(gw)
            for f in range(k):
                dv = np.bincount(flat, g[at] * (s[at, f] - vf[:, f]), len(w)) + decay * v[:, f]
                gv[:, f] += dv * dv
                v[:, f] -= 0.3 * rate * dv / np.sqrt(gv[:, f])
    return Machine(bias, buckets, w, v, key)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, label_col: str = "toxic", held_out: Column | None = None) -> Machine:
    """Fit on at most ``max_rows`` labelled rows; rows for which ``held_out`` (an expression of doc_id) holds are never read."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    if held_out is not None:
        marks = marks.filter(~held_out)
    marks = marks.groupBy("doc_id").agg(F.max((F.col("label") > 0).cast("int")).alias("label"))
    order = [F.xxhash64(F.lit("toxicity"), "doc_id"), F.col("doc_id")]
    found = {v: marks.filter(F.col("label") == v).orderBy(*order).limit(max_rows).collect() for v in (0, 1)}  # 2 * max_rows pairs of integers at most
    most_toxic = max(max_rows // 2, max_rows - len(found[0]))
    sample = found[1][:most_toxic]
    taken = {1: len(sample), 0: min(len(found[0]), max_rows - len(sample))}
    sample += found[0][: taken[0]]
    there = {r[0]: r[1] for r in marks.groupBy("label").count().collect()}
    if not sample:
        return train([], np.zeros(0), np.zeros(0, np.int32))
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    chosen = F.broadcast(spark.createDataFrame(pd.DataFrame({"doc_id": [r[0] for r in sample], "label": [r[1] for r in sample]}), "doc_id long, label int"))
    # One row for each sampled id, written once: max_rows texts at most.
    one = texts_of(docs).join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("row"))
    rows = scratch.save(one.select("doc_id", "row.text", "row.label"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = np.zeros((2, 1 << BITS), np.int64)
        for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            sums[label, document_terms(text)] += 1
        some = np.flatnonzero(sums.sum(axis=0))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[0, some]), pa.array(sums[1, some])], names=["bucket", "clean", "toxic"])

    n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return train([np.zeros(0, np.int64)] * (n0 + n1), np.array([0] * n0 + [1] * n1, float), np.zeros(0, np.int32))
    sums = scratch.save(map_batches(rows, count, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).filter("c + t >= 3"))
    alone = sums.withColumn("chi", chi_square(F.col("c").cast("double"), F.col("t").cast("double"), float(n0), float(n1)))
    best = alone.filter(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "bucket").limit(MOST_TERMS).select("bucket").collect()
    often = sums.filter(F.col("c") + F.col("t") < 0.95 * (n0 + n1)).orderBy(F.desc(F.col("c") + F.col("t")), "bucket").limit(PAIRED_TERMS).select("bucket").collect()
    telling, often = (np.array(sorted(r[0] for r in x), np.int32) for x in (best, often))
    either = np.union1d(telling, often)

    def index(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.flatnonzero(np.isin(either, document_terms(text), assume_unique=True)).astype(np.int32).tobytes() for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own, pa.binary())], names=["doc_id", "label", "terms"])

    fitted = map_batches(rows, index, "doc_id long, label int, terms binary").collect()  # max_rows rows of MOST_TERMS + PAIRED_TERMS numbers at most
    scratch.keep_only()
    fitted.sort(key=lambda r: r[0])
    terms_of = [np.frombuffer(r[2], np.int32).astype(np.int64) for r in fitted]
    labels_of = np.array([r[1] for r in fitted], float)
    buckets = np.union1d(telling, either[paired(terms_of, labels_of, np.flatnonzero(np.isin(either, often)))])
    place = np.full(len(either), -1)
    place[np.isin(either, buckets)] = np.arange(len(buckets))
    terms_of = [p[p >= 0] for p in (place[own] for own in terms_of)]
    machine = train(terms_of, labels_of, buckets)
    # Both classes have rows here; which part of each was taken shows in the bias only.
    return replace(machine, bias=machine.bias - sampling_log_odds(taken, there))


def chi_square(clean, toxic, n_clean: float, n_toxic: float):
    """How far the share of toxic rows among ``clean + toxic`` rows is from that of all; columns, numbers or arrays."""
    whole, used = n_clean + n_toxic, clean + toxic
    apart = toxic * (n_clean - clean) - clean * (n_toxic - toxic)
    return whole * apart * apart / (used * (whole - used + 1) * n_clean * n_toxic)


def paired(rows: list[np.ndarray], labels: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Those of the terms ``often`` that are in a pair of them which tells the classes apart better than both alone."""
    k = len(often)
    if not k:
        return often
    place = np.full(max(int(often.max()), max((int(r.max()) for r in rows if len(r)), default=0)) + 1, -1)
    place[often] = np.arange(k)
    both = {0: np.zeros((k, k), np.float32), 1: np.zeros((k, k), np.float32)}
    for label, sums in both.items():
        own = [rows[i] for i in np.flatnonzero(labels == label)]
        for start in range(0, len(own), 1024):
            part = np.zeros((min(1024, len(own) - start), k), np.float32)
            for at, r in enumerate(own[start : start + 1024]):
                p = place[r]
                part[at, p[p >= 0]] = 1
            sums += part.T @ part
    n = [float((labels == v).sum()) for v in (0, 1)]
    clean, toxic = (both[v].astype(np.float64) for v in (0, 1))
    chi = np.where(clean + toxic >= 3, chi_square(np.where(clean + toxic, clean, 1), toxic, *n), 0)
    alone = np.diag(chi)
    better = chi >= np.maximum(alone[:, None], alone[None, :]) + LEAST_PAIR_CHI
    np.fill_diagonal(better, False)
    return often[better.any(axis=1)]


def sampling_log_odds(taken: dict[int, int], there: dict[int, int]) -> float:
    """Log of how many times likelier a toxic row was taken into the sample than a clean one."""
    return float(np.log(taken[1] / there[1]) - np.log(taken[0] / there[0]))


def score(machine: Machine, docs: DataFrame, text: Column) -> Column:
    """Scores of whole texts, as a column."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        one = kept(("machine", sent.value.key, sent.value.bias), lambda: sent.value.scorer())
        return pd.Series([one(x) for x in texts], dtype="float64")

    return scores(F.coalesce(text.cast("string"), F.lit("")))


def held_out_rows(remainder: int = 2, of: int = 4) -> Column:
    """The rows no label is learned from: crc32 of doc_id's digits leaves ``remainder``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == remainder, F.lit(False))
