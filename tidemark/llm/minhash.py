"""Near-duplicates by HyperMinHash: compressed registers, banding, corrected estimates, full verification.

1.  Each text becomes the set of its word shingles and 128 registers of 16 bits
    (leading zeros and mantissa of each bucket's minimum).  Equal sets collapse
    to one row, the node; only nodes go on.
2.  32 bands of four registers give keys; keys with two or more nodes are
    buckets.  Two sets with similarity 0.8 miss each other in all bands once in
    20 million.
3.  Round 1 sets each member against one member of its bucket: as many pairs as
    members.  Pairs whose corrected estimate is below the threshold by
    ``LEAST_ESTIMATE_GAP`` are left out (five standard errors and more; sets of
    fewer than 64 shingles are never left out), the others are verified on the
    full sets.  Verified links give components.
4.  Round 2 does the same in buckets that still hold several components, now
    with the most typical member: the one with the largest share of shingles
    that others hold too.  What was made from a common text mostly links there.
5.  Round 3 settles the rest exactly.  Shingles are put in one order, rarest
    first; two sets of similarity t share a shingle among the first
    ``n - ceil(t n) + 1`` of either.  Members outside their bucket's largest
    component are joined to the others by these shingles, and only pairs that
    sizes and places in the order allow come out.  Shingles of one set only make
    no pair, so a set with many of its own meets nobody.  A pair must share a
    band and pass its estimate, as before, to be verified.

Steps 4 and 5 look at no pair within a component.  No bucket is gathered in one
task: buckets are counted with partial aggregation and joined by their key, and
joins of written tables split skewed keys.

Defined results: null texts and texts without words have the empty set and link
with nothing; fewer words than a shingle's are one shingle; repeated rows fall
into one component; rows of one doc_id with several texts are one document,
which the links of each of them join (its rows without words still stand
alone); rows without doc_id are kept and stand alone; very long texts count
whole; columns other than id and text are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, kept, map_batches, small_batches, texts_of
from tidemark.llm.components import components
from tidemark.llm.shingles import REGISTERS, ROWS, Words, band_keys, digest, estimates, registers, shingle_set

LEAST_ESTIMATE_GAP = 0.2  #: an estimate this far below the threshold rules a pair out
SMALL_SET = 64  #: sets with fewer shingles are verified whatever the estimate
#: Ids to look up are broadcast up to this many (8 bytes each); beyond it they are joined by a shuffle.
MOST_BROADCAST = 1 << 20


def _words() -> Words:
    return kept("shingle words", Words)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, n (distinct shingles), digest of the set, registers (null for the empty set)."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, dig, regs, words = [], [], [], _words()
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, width, words)
            n.append(len(s))
            dig.append(digest(s))
            regs.append(registers(s).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dig, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n", "digest", "registers"])

    return map_batches(docs, per_batch, "doc_id long, n long, digest binary, registers binary")


def bands(nodes: DataFrame) -> DataFrame:
    """(key, node) for each band of each node (node, registers)."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        keys = band_keys(regs)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).reshape(-1)), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], names=["key", "node"])

    return map_batches(nodes.select("node", "registers"), per_batch, "key long, node long")


def full_sets(texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes (node, doc_id, digest), their shingles taken from the texts again."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = _words()
        own = [shingle_set(x, width, words) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([digest(s) for s in own], pa.binary()), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))], names=["doc_id", "digest", "shingles"]
        )

    few = nodes.count() <= MOST_BROADCAST
    side = F.broadcast if few else lambda x: x
    chosen = texts.join(side(nodes.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text")
    # Rows repeated as a whole have one node and one set.
    return map_batches(chosen, sets, "doc_id long, digest binary, shingles array<long>").join(side(nodes), ["doc_id", "digest"]).select("node", "shingles").dropDuplicates(["node"])


def verified(pairs: DataFrame, nodes: DataFrame, full: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links (a, b: structs of doc_id and node) among distinct pairs (a, b) of nodes, by estimate and then by full sets."""
    top, bottom = threshold
    least = top / bottom - LEAST_ESTIMATE_GAP
    schema = "da long, a long, db long, b long"
    names = ["da", "a", "db", "b"]

    def likely(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in ("ra", "rb"))
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        same = a == b
        meet = same.reshape(len(same), -1, ROWS).all(axis=2).any(axis=1)
        fits = np.minimum(na, nb) * bottom >= np.maximum(na, nb) * top
        keep = np.flatnonzero(meet & fits & ((estimates(same.mean(axis=1), na, nb) >= least) | (np.minimum(na, nb) < SMALL_SET)))
        return pa.RecordBatch.from_arrays([batch.column(k) for k in names], names=names).take(pa.array(keep))

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for k, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            if bottom * both >= top * (len(x) + len(y) - both):
                keep.append(k)
        return pa.RecordBatch.from_arrays([batch.column(k) for k in names], names=names).take(pa.array(keep, pa.int64()))

    known = [nodes.select(F.col("node").alias(k), F.col("doc_id").alias(f"d{k}"), F.col("n").alias(f"n{k}"), F.col("registers").alias(f"r{k}")) for k in "ab"]
    some = map_batches(pairs.join(known[0], "a").join(known[1], "b"), likely, schema)
    whole = [full.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab"]
    links = map_batches(some.join(whole[1], "b").join(whole[0], "a").select(*names, "sa", "sb"), verify, schema)
    return links.select(F.struct(F.col("da").alias("doc_id"), F.col("a").alias("node")).alias("a"), F.struct(F.col("db").alias("doc_id"), F.col("b").alias("node")).alias("b"))


def _looked_up(scratch: Scratch, by_key: DataFrame) -> DataFrame:
    """A table of one row a key, written, so that a join with it can split hot keys; broadcast up to ``MOST_BROADCAST``."""
    saved = scratch.save(by_key)
    return F.broadcast(saved) if saved.count() <= MOST_BROADCAST else saved


def unsettled(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, comp, main) of buckets of three and more members that hold several components; main is the largest."""
    placed = members.join(labels.select(F.col("node.node").alias("node"), F.col("label.node").alias("comp")), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    placed = scratch.save(placed)
    by_comp = placed.groupBy("key", "comp").agg(F.count("*").alias("m"))
    several = by_comp.groupBy("key").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("m", "comp")).alias("main"), F.sum("m").alias("size")).filter("comps > 1 and size > 2")
    return placed.join(_looked_up(scratch, several.select("key", "main")), "key")


def profiles(full: DataFrame, wanted: DataFrame, threshold: tuple[int, int], scratch: Scratch | None = None) -> DataFrame:
    """Of the nodes in ``wanted``: n, common (shingles that another of them holds too) and prefix, those of the first shingles in the order that are common.

    Nodes that can have no partner among them are left out.
    """
    top, bottom = threshold
    sets = full.join(wanted, "node", "left_semi")
    spelled = sets.select("node", F.explode("shingles").alias("s"))
    # Written, so that the join can split a shingle that many sets hold.
    counts = spelled.groupBy("s").agg(F.count("*").alias("m")).filter("m > 1")
    counts = scratch.save(counts) if scratch else counts
    shared = spelled.join(counts, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("m", "s"))).alias("shared"))
    out = sets.select("node", F.size("shingles").cast("long").alias("n")).join(shared, "node").withColumn("common", F.size("shared").cast("long"))
    # The first n - ceil(t n) + 1 shingles begin with those that no other set holds.
    first = F.col("n") - F.ceil(F.col("n") * top / bottom) + 1 - (F.col("n") - F.col("common"))
    return out.withColumn("first", first.cast("int")).filter("first > 0").select("node", "n", "common", F.transform(F.slice("shared", 1, F.greatest("first", F.lit(0))), lambda x: x["s"]).alias("prefix"))


def prefix_pairs(left: DataFrame, right: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Distinct pairs (a, b) of nodes of ``left`` and ``right`` (node, comp, n, common, prefix) in several components that may be similar."""
    top, bottom = threshold

    def spread(side: DataFrame, k: str) -> DataFrame:
        return side.select(F.col("node").alias(f"node{k}"), F.col("comp").alias(f"comp{k}"), F.col("n").alias(f"n{k}"), F.col("common").alias(f"common{k}"), F.posexplode("prefix").alias(f"at{k}", "s"))

    size = F.col("na") + F.col("nb")
    # Where s is the first shingle that both hold, they share no more than what stands from there on in either.
    most = F.least(F.col("commona") - F.col("ata"), F.col("commonb") - F.col("atb"))
    allowed = (F.col("compa") != F.col("compb")) & (F.least("na", "nb") * bottom >= F.greatest("na", "nb") * top) & (most * (top + bottom) >= size * top)
    return spread(left, "a").join(spread(right, "b"), "s").filter(allowed).select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b")).distinct()


def near_components(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    ``threshold`` is the least similarity of a link as a fraction of integers.
    """
    top, bottom = threshold
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "minhash")
    texts = texts_of(docs, id_col, text_col)
    # Numbers are given once, as the table is written, and read from it ever after.
    rows = scratch.save(sketches(texts, width).withColumn("node", F.monotonically_increasing_id()))
    real = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # Written first: a join of two plain shuffles can split a digest that many rows share.
    classes = scratch.save(real.groupBy("digest").agg(F.min(F.struct("doc_id", "node")).alias("low"), F.count("*").alias("size")).filter("size > 1").select("digest", "low"))
    nodes = scratch.save(real.join(classes, "digest", "left").filter(F.col("low").isNull() | (F.col("low.node") == F.col("node"))).select("node", "doc_id", "n", "digest", "registers"))

    keyed = bands(nodes)
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("center")).filter(F.col("size") > 1)
    # Written first, as above, for a key that many nodes have.
    buckets = scratch.save(buckets.select("key", "center"))
    members = scratch.save(keyed.join(buckets, "key"))
    scratch.drop(buckets)
    candidates = members.select("node").distinct()
    full = scratch.save(full_sets(texts, nodes.select("node", "doc_id", "digest").join(candidates, "node", "left_semi"), width))

    stars = members.filter("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    labels = components(scratch.save(verified(stars, nodes, full, threshold)), scratch)

    def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
        return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).filter("a != b").union(links), scratch)

    held = scratch.save(unsettled(members, labels, scratch))
    known = scratch.save(profiles(full, held.select("node").distinct(), threshold, scratch))
    held = scratch.save(held.join(known.drop("prefix"), "node"))
    typical = held.groupBy("key").agg(F.max_by(F.struct("node", "comp", "n", "common"), F.struct(F.col("common") / F.col("n"), "n", "node")).alias("t"))
    # Two sets share at least t / (1 + t) of their sizes together, and at most what is common of either.
    able = (F.least("n", "t.n") * bottom >= F.greatest("n", "t.n") * top) & (F.least("common", "t.common") * (top + bottom) >= (F.col("n") + F.col("t.n")) * top)
    stars = held.join(_looked_up(scratch, typical), "key").filter((F.col("comp") != F.col("t.comp")) & able).select(F.least("node", "t.node").alias("a"), F.greatest("node", "t.node").alias("b")).distinct()
    labels = joined(labels, scratch.save(verified(stars, nodes, full, threshold)))

    held = unsettled(held.select("key", "node"), labels, scratch)
    placed = scratch.save(held.groupBy("node").agg(F.first("comp").alias("comp"), F.max(F.col("comp") != F.col("main")).alias("aside")).join(known, "node"))
    pairs = prefix_pairs(placed.filter("aside"), placed, threshold)
    links = scratch.save(verified(pairs, nodes, full, threshold))
    # Documents with several texts: each of them is linked to the first.
    several = real.groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).filter("one != other").select("doc_id")
    texts_of_one = scratch.save(real.join(several, "doc_id").join(classes, "digest", "left").select("doc_id", F.coalesce("low", F.struct("doc_id", "node")).alias("b")).distinct())
    links = links.union(texts_of_one.join(texts_of_one.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").filter("a != b").select("a", "b"))
    labels = joined(labels, links)

    linked = labels.select(F.col("node.node").alias("node"), F.col("label.doc_id").alias("component")).join(nodes.select("node", "digest"), "node")
    named = classes.select("digest", F.col("low.doc_id").alias("low")).join(linked.select("digest", "component"), "digest", "full").select("digest", F.coalesce("component", "low").alias("component"))
    named = scratch.save(named)
    is_real = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = rows.select("doc_id", "n", "digest").join(named, "digest", "left").withColumn("component_id", F.when(is_real, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
    scratch.keep_only(rows, named)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
