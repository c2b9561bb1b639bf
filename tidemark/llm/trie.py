"""The trie of conversation prefixes, from sorted conversations: range minima over their common prefixes.

1.  Each turn becomes 128 bits of a digest of role and text, each conversation
    the string of these; conversations are range-sorted by it (equal ones by
    conv_id, so copies spread over partitions) and written in blocks.
2.  In a block, neighbours' longest common prefixes (LCP) are set up as a sparse
    table of range minima.  Every prefix that begins in the block is a candidate;
    each one searches its left and right extents by itself, halving steps over
    the table: its members are an interval, and counts, leaves, children and
    savings are differences of prefix sums over it.
3.  Blocks know the last conversation before them and the first one after, so each
    node, leaf and child is counted in the block where it begins.  Nodes that touch
    a block's edge leave their sums, and the conv_ids that end there, under the
    digest of their prefix; rows of one digest are added in order of blocks by a
    streaming pass.  There are at most two paths of such nodes a block.

Memory: a block has about ``BLOCK`` conversations, whatever they share.  A
conversation's digests (16 bytes a turn) are one value, as a long text would be.

Defined results: rows without conv_id belong to no conversation and are left out;
a null role or text is empty; turns are ordered null first, equal turns by role
and text, repeated rows are turns each; an empty table has no node, not even a
root; columns other than these four are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Scratch, small_batches

WIDTH = 16  #: bytes of a turn's digest
BLOCK = 20_000  #: conversations a block is meant to hold
GROUP = 100  #: conversations that share the head of one
HEADS = 6  #: heads have fewer turns than this
MOST_BROADCAST = 1 << 20

_NODE = "node binary, parent binary, block long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, ends_sha256 string"


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (digest, chars) in order)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).filter("conv_id IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * WIDTH)
    placed = rows.select("conv_id", place.alias("place"), digest.alias("digest"), F.length("text").cast("long").alias("chars"))
    return placed.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest", "chars"))), lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars"))).alias("turns"))


def head_length(conv_id: Column) -> Column:
    """How many turns of its group's first conversation a rebuilt one begins with."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, key, chars): each conversation behind the head of its group's first one; digests as one string, lengths of texts."""
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = own.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = head_length(F.col("conv_id"))
    none = F.array().cast(own.schema["turns"].dataType)
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns") + 1))
    joined = own.withColumn("base", base).join(heads, "base", "left").select("conv_id", turns.alias("turns"))
    return joined.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("key"), F.col("turns.chars").alias("chars"))


def common_prefix(keys: list[bytes]) -> np.ndarray:
    """Turns that each key shares with the one before it (0 for the first)."""
    out = np.zeros(len(keys), np.int64)
    for k in range(1, len(keys)):
        a, b = keys[k - 1], keys[k]
        if a == b:
            out[k] = len(a) // WIDTH
            continue
        n = min(len(a), len(b)) // WIDTH
        if n < 16:
            d = 0
            while d < n and a[d * WIDTH : (d + 1) * WIDTH] == b[d * WIDTH : (d + 1) * WIDTH]:
                d += 1
        else:
            differ = np.frombuffer(a, np.uint64, 2 * n) != np.frombuffer(b, np.uint64, 2 * n)
            d = int(differ.argmax()) // 2 if differ.any() else n
        out[k] = d
    return out


def sparse_table(values: np.ndarray, of=np.minimum) -> list[np.ndarray]:
    """Level k holds the minima of runs of 2**k values."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        last, half = levels[-1], 1 << (len(levels) - 1)
        levels.append(of(last[:-half], last[half:]))
    return levels


def extents(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of the interval around ``row`` whose rows share ``depth`` turns; each by its own search over LCP minima."""
    n = len(table[0])
    left, right = row.copy(), row.copy()
    for k in range(len(table) - 1, -1, -1):
        step = 1 << k
        low = table[k][(left - step + 1).clip(0, n - step)]
        left = np.where((left - step >= 0) & (low >= depth), left - step, left)
        low = table[k][(right + 1).clip(0, n - step)]
        right = np.where((right + step < n) & (low >= depth), right + step, right)
    return left, right


def range_min(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minima of the rows from ``left`` to ``right``."""
    k = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    out = np.empty(len(left), np.int64)
    for level in np.unique(k):
        at = k == level
        out[at] = np.minimum(table[level][left[at]], table[level][right[at] - (1 << int(level)) + 1])
    return out


def _prefix_digests(key: bytes) -> list[bytes]:
    """A digest of each prefix of a key, the empty one first."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for a in range(0, len(key), WIDTH):
        h.update(key[a : a + WIDTH])
        out.append(h.digest())
    return out


def block_nodes(block: int, conv: np.ndarray, keys: list[bytes], chars: list[np.ndarray], before: bytes | None, after: bytes | None) -> dict[str, list]:
    """The nodes of one sorted block.  ``before``, ``after``: the neighbours' keys, None at either end of all."""
    n = len(keys)
    lengths = np.array([len(k) // WIDTH for k in keys], np.int64)
    lcp = common_prefix(keys)
    # The first row shares nothing within the block, so all its prefixes are candidates; ``edge`` of them begin in an earlier one.
    edge = int(common_prefix([before, keys[0]])[1]) if before is not None else -1
    new_from = lcp + 1  # the first depth that begins at this row
    new_from[0] = edge + 1
    onward = np.append(lcp[1:], common_prefix([keys[-1], after])[1] if after is not None else -1)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.concatenate([[0], np.cumsum(np.concatenate([np.asarray(c, np.int64) for c in chars]) if starts[-1] else np.zeros(0, np.int64))])
    total = flat[starts[1:]] - flat[starts[:-1]]

    def up_to(row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Code points of the first ``depth`` turns."""
        return flat[starts[row] + depth.clip(0)] - flat[starts[row]]

    rows = np.arange(n)
    begun = total - up_to(rows, np.maximum(new_from, 1) - 1)  # code points of the nodes that begin at a row
    leaf = onward < lengths
    first = np.where(rows == 0, 0, lcp + 1)
    counts = lengths - first + 1
    row = np.repeat(rows, counts.clip(0))
    depth = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, lengths, strict=True)])
    left, right = extents(sparse_table(lcp), row, depth)

    def summed(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(x)])
        return s[b + 1] - s[a]

    n_convs = right - left + 1
    all_chars = summed(total, left, right) - n_convs * up_to(left, depth - 1)
    # Nodes of the subtree: all that begin at later rows, and at the first row those from this depth on.
    distinct = summed(begun, left, right) - begun[left] + total[left] - up_to(left, np.maximum(np.maximum(depth, new_from[left]), 1) - 1)
    longer = np.flatnonzero((lengths > lcp) & (rows > 0))
    coded = np.sort(lcp[longer] * n + longer)
    children = np.searchsorted(coded, depth * n + right, "right") - np.searchsorted(coded, depth * n + left, "right")
    children += (lengths[left] > depth) & (new_from[left] <= depth + 1)
    at_edge = (left == 0) | (right == n - 1)
    same = sparse_table(np.where(np.append(False, (lcp[1:] == lengths[1:]) & (lengths[1:] == lengths[:-1])), 1, 0))
    low = range_min(sparse_table(conv), left, right)
    ends_to = extents(same, left, np.ones(len(left), np.int64))[1]
    # The parent of a candidate at depth d holds it, so it is the last candidate before it at depth d - 1.
    parent_at: list[int] = []
    path: dict[int, int] = {}
    for k, d in enumerate(depth.tolist()):
        parent_at.append(path.get(d - 1, -1))
        path[d] = k
    parent_at = np.array(parent_at)
    out = {k: [] for k in ("node", "parent", "ends", "ends_sha256", "parent_conv_id")}

    # A node at an edge is a prefix of the first key or of the last one.
    names = {True: _prefix_digests(keys[0]), False: _prefix_digests(keys[-1])}

    def name(k: int) -> bytes:
        return names[bool(left[k] == 0)][depth[k]]

    texts = [b"%d" % c for c in conv.tolist()]
    for k in range(len(row)):
        p = parent_at[k]
        ends = b",".join(texts[left[k] : ends_to[k] + 1]) if lengths[left[k]] == depth[k] else b""
        edge_parent = p >= 0 and at_edge[p]
        out["node"].append(name(k) if at_edge[k] else None)
        out["parent"].append(name(p) if edge_parent else None)
        out["parent_conv_id"].append(int(low[p]) if p >= 0 and not edge_parent else None)
        out["ends"].append(ends if at_edge[k] else None)
        out["ends_sha256"].append(None if at_edge[k] else hashlib.sha256(ends).hexdigest())
    return out | {
        "block": [block] * len(row), "conv_id": low, "depth": depth, "n_convs": n_convs, "n_children": children,
        "n_leaves": summed(leaf.astype(np.int64), left, right), "saved_tokens": all_chars - distinct,
    }


def _blocks(sorted_rows: DataFrame) -> DataFrame:
    """(block, before, after): the keys next to each block.  Only the numbers of the blocks come to the driver."""
    ends = sorted_rows.groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    numbers = sorted(r[0] for r in sorted_rows.select("block").distinct().toLocalIterator())
    if not numbers:
        return ends.select("block", F.col("first").alias("before"), F.col("last").alias("after"))
    order = F.broadcast(ends.sparkSession.createDataFrame([(b, a, c) for a, b, c in zip([None, *numbers[:-1]], numbers, [*numbers[1:], None], strict=True)], "block long, previous long, next long"))
    before, after = ends.select(F.col("block").alias("previous"), F.col("last").alias("before")), ends.select(F.col("block").alias("next"), F.col("first").alias("after"))
    return order.join(before, "previous", "left").join(after, "next", "left").select("block", "before", "after")


def prefix_nodes(sequences: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of ``sequences`` (conv_id, key: 16 bytes a turn, chars: of each turn)."""
    spark = sequences.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "trie")
    sequences = scratch.save(sequences)
    n = sequences.count()
    parts = max(1, -(-n // block), min(spark.sparkContext.defaultParallelism, -(-n // 1000)))
    placed = sequences.repartitionByRange(parts, "key", "conv_id").withColumn("block", F.spark_partition_id().cast("long"))
    placed = scratch.save(placed)
    edges = scratch.save(_blocks(placed))

    def nodes(of: tuple, mine: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values(["key", "conv_id"], ignore_index=True)
        before, after = (edge[c].iloc[0] for c in ("before", "after"))
        found = block_nodes(int(of[0]), mine["conv_id"].to_numpy(np.int64), list(mine["key"]), list(mine["chars"]), before, after)
        return pd.DataFrame({c.split()[0]: pd.Series(found[c.split()[0]], dtype="Int64" if c.endswith("long") else None) for c in _NODE.split(", ")})

    found = scratch.save(placed.groupBy("block").cogroup(edges.groupBy("block")).applyInPandas(nodes, _NODE))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        now, sha, empty = None, None, True

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([now | {"ends_sha256": sha.hexdigest()}], pa.schema([(c, pa.binary() if c in names[:2] else pa.string() if c == names[-1] else pa.int64()) for c in names]))

        for batch in batches:
            for x in batch.to_pylist():
                ends = x.pop("ends")
                if now is None or x["node"] != now["node"]:
                    if now is not None:
                        yield told()
                    now, sha, empty = {c: x[c] for c in names[:-1]}, hashlib.sha256(), True
                else:
                    for c in names[4:-1]:
                        now[c] += x[c]
                    now["conv_id"] = min(now["conv_id"], x["conv_id"])
                if ends:
                    sha.update(ends if empty else b"," + ends)
                    empty = False
        if now is not None:
            yield told()

    # Rows of one node: at most one a block, read in the order of blocks, so ids that end there keep their order.
    edge_rows = found.filter("node IS NOT NULL").drop("parent_conv_id", "ends_sha256")
    merged = edge_rows.repartition("node").sortWithinPartitions("node", "block").mapInArrow(add, "node binary, parent binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    merged = scratch.save(merged)
    lowest = merged.select(F.col("node").alias("above"), F.col("conv_id").alias("low"))
    lowest = F.broadcast(lowest) if merged.count() <= MOST_BROADCAST else lowest
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = found.filter("node IS NULL").join(lowest, F.col("parent") == F.col("above"), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "low"))
    outer = merged.join(lowest, F.col("parent") == F.col("above"), "left").withColumn("parent_conv_id", F.col("low"))
    scratch.keep_only(found, merged)
    return inner.select(names).unionByName(outer.select(names))


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return prefix_nodes(rebuilt(own_turns(conversations)), block)
