"""Best-fit packing of token pieces into sequences, bulk-synchronously.

1.  Documents are encoded on the executors; of each piece only its place, its
    length and a checksum are written to the shared folder.
2.  Pieces are range-sorted by length.  Every piece gets its rank among the
    pieces of its length: its number within its partition plus what earlier
    partitions hold of that length.  A range partition meets few lengths, so
    the table of counts has at most (partitions + lengths) rows.
3.  Supersteps match pieces to gaps, longest pieces first.  The sweep goes over
    the sorted gaps and finds for a length the smallest gap that holds it.
    Ranks settle who gets which: of ``n`` pieces and ``m`` equal gaps the first
    ``min(n, m)`` of either are matched, the gaps shrink and are sorted in
    again, and what is left takes the next larger gap, or opens sequences.
    Because pieces of one length and gaps of one size are alike, a superstep
    works on their counts: at most ``capacity`` lengths, whatever the number of
    documents.  The result is that of sequential best-fit-decreasing.
4.  A plan row says: ranks from .. to of a length go to sequences from .. at an
    offset.  All pieces look theirs up where they are, without a shuffle.

Defined results: a null text counts as empty; an empty document is one piece
that holds only the end id; repeated rows are packed each; very long documents
are cut into whole sequences, the first piece being shorter; which of equal pieces
goes where is any; a null doc_id is packed as any other; columns other than id and
text are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, file_bytes, kept, map_batches, texts_of


class ByteBpe:
    """Ids of a byte-level BPE vocabulary, as the tokenizers library gives them, through a cache of chunks.

    A chunk begins at a single space or line end with no white space at either
    side: no pre-token reaches across that place, so chunks are encoded alone.
    """

    def __init__(self, spec: bytes, pattern: str):
        import tiktoken

        model = json.loads(spec)
        points = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in points}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(points))}
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.special = special
        self.encoding = tiktoken.Encoding("byte bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.cache: dict[str, bytes] = {}
        self.run = re.compile(r"\s\s")

    def _plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode(text, allowed_special="all"), np.uint32).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids; a special token's string in the text is that token, as in the library."""
        if "\x00" in text or any(s in text for s in self.special) or self.run.search(text):
            return b"".join(self._plain(part) for part in self._safe_parts(text))
        cache, out, ordinary = self.cache, [], self.encoding.encode_ordinary
        for chunk in text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00"):
            got = cache.get(chunk)
            if got is None:
                got = array("I", ordinary(chunk)).tobytes()
                if len(chunk) <= 48:
                    if len(cache) >= 400_000:
                        cache.clear()
                    cache[chunk] = got
            out.append(got)
        return b"".join(out)

    def _safe_parts(self, text: str):
        """Parts of a very long text, cut only at a space between two ASCII letters."""
        step, start = 1 << 18, 0
        while len(text) - start > step:
            cut = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])").search(text, start + step)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    sent = docs.sparkSession.sparkContext.broadcast(file_bytes(tokenizer_path))
    end = np.array([end_id], np.uint32).tobytes()

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = kept(("byte bpe", tokenizer_path), lambda: ByteBpe(sent.value, pattern))
        ids_of, piece, start, length, crc = [], [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = bpe.encode(text) + end
            n = len(ids) // 4
            first = (n - 1) % capacity + 1
            at, number = 0, 0
            while at < n:
                size = capacity if number else first
                ids_of.append(doc)
                piece.append(number)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                at, number = at + size, number + 1
        return pa.RecordBatch.from_arrays([pa.array(ids_of, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(texts_of(docs, id_col, text_col), per_batch, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, rank from, rank to, sequence from, offset) of best-fit-decreasing on counts of equal lengths."""
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # size of gap -> runs (first sequence, how many)
    sizes: list[int] = []  # sorted sizes with any gap
    opened = 0

    def add(gap: int, first: int, n: int) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(sizes, gap)
        own = gaps[gap]
        if own and own[-1][0] + own[-1][1] == first:
            own[-1] = (own[-1][0], own[-1][1] + n)
        else:
            own.append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens; sequences hold {capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                n = -(-left // (capacity // length))
                add(capacity, opened, n)
                opened += n
                at = bisect.bisect_left(sizes, length)
            gap = sizes[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            take = min(n, left)
            plan.append((length, rank, rank + take, first, capacity - gap))
            if take < n:
                add(gap, first + take, n - take)
            if gap > length:
                add(gap - length, first, take)
            left, rank = left - take, rank + take
    return plan


def pack(found: DataFrame, capacity: int = 1024, partitions: int | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset: as few sequences of ``capacity`` as best-fit-decreasing gives."""
    spark = found.sparkSession
    scratch = Scratch(spark, "packing")
    parts = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Range bounds are sampled by a pass of their own; written first, documents are encoded once.
    found = scratch.save(found.select("doc_id", "piece", "start", "length", "ids_crc32"))
    ordered = found.repartitionByRange(parts, F.col("length").desc(), F.xxhash64("doc_id", "piece")).sortWithinPartitions(F.col("length").desc(), F.xxhash64("doc_id", "piece"))

    def number(batches):
        from pyspark import TaskContext

        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            if not len(lengths):
                continue
            new = np.flatnonzero(np.append(True, lengths[1:] != lengths[:-1]))
            rank = np.arange(len(lengths)) - np.repeat(new, np.diff(np.append(new, len(lengths))))
            if lengths[0] == last:
                rank[: new[1] if len(new) > 1 else len(rank)] += count
            last, count = int(lengths[-1]), int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(rank), part, np.int32)), pa.array(rank.astype(np.int64))], names=[*batch.schema.names, "part", "rank"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    ranked = scratch.save(ordered.mapInArrow(number, f"{schema}, part int, rank long"))
    scratch.keep_only(ranked)
    held = ranked.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = held.select("length", "part", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    table = before.collect()  # partitions + capacity rows at most
    counts: dict[int, int] = {}
    for r in table:
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    plan = sorted(best_fit_plan(counts, capacity))
    shift = 44
    keys = np.array([(p[0] << shift) + p[1] for p in plan], np.int64)
    ranks, firsts, offsets = (np.array([p[k] for p in plan], np.int64) for k in (1, 3, 4))
    base = {(r["part"], r["length"]): r["before"] for r in table}
    sent = spark.sparkContext.broadcast((keys, ranks, firsts, offsets, base))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, ranks, firsts, offsets, base = sent.value
        length = batch.column("length").to_numpy()
        part = batch.column("part").to_numpy()
        both, where = np.unique(part.astype(np.int64) << 32 | length, return_inverse=True)
        rank = batch.column("rank").to_numpy() + np.array([base[int(b) >> 32, int(b) & 0xFFFFFFFF] for b in both], np.int64)[where]
        row = np.searchsorted(keys, (length.astype(np.int64) << shift) + rank, side="right") - 1
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(firsts[row] + rank - ranks[row]), pa.array(offsets[row])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_batches(ranked, place, f"{schema}, sequence_id long, offset long")
