"""Line de-duplication: lines that many documents share are dropped everywhere but in one document.

Texts are split at line ends; each line long enough gives (hash of its
normalised form, doc_id), distinct within a document where it lies.  Documents
are counted per hash with partial aggregation, so a line that a third of all
documents holds meets as one row of each task.  The hashes to drop are written,
so that the join back can split one that many documents hold, and gathered per
document; each text that loses a line is put together again from the lines that
stay, by position.  Texts that lose none are not shuffled, as long as the ids of
those that do are few enough to be broadcast.

Hashes are 128 bits of BLAKE2b.  Defined results: a null or empty text is one
empty line; null doc_ids count as one document smaller than any other; repeated
rows of a doc_id count as one document and are treated alike; lines of repeated
text within a document count once; very long texts and lines count whole; columns
other than id and text are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, map_batches, texts_of

#: Ids of documents that lose lines are broadcast up to this many (8 bytes each); beyond it all texts are joined by a shuffle.
MOST_BROADCAST = 1 << 20
WHITE = b" \t\n\v\f\r"


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip(WHITE).lower()


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line's key, or None if it has fewer than ``min_chars`` code points."""
    key = line_key(line)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def frequent_lines(docs: DataFrame, scratch: Scratch, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Lines to drop: (doc_id, hash) of every document but the largest doc_id that holds a line of ``min_docs`` documents."""

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, hashes = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = {line_hash(x, min_chars) for x in set(text.encode("utf-8").split(b"\n"))}
            own.discard(None)
            ids.extend([doc] * len(own))
            hashes.extend(own)
        return pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.int64())], names=["hash", "doc_id"])

    lines = map_batches(docs, explode, "hash binary, doc_id long")
    # Rows of one doc_id meet first only where ids repeat; a plain count would count them twice.
    distinct = lines.groupBy("hash", "doc_id").agg(F.lit(1).alias("one"))
    counts = distinct.groupBy("hash").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_id")).filter(F.col("n_docs") >= min_docs)
    counts = scratch.save(counts.select("hash", "keep_id"))
    return distinct.join(counts, "hash").filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "hash")


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_lines (before), n_dropped, text (of the lines that stay)."""
    texts = texts_of(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "lines")
    gone = scratch.save(frequent_lines(texts, scratch, min_chars, min_docs).groupBy(F.col("doc_id").alias("of")).agg(F.collect_list("hash").alias("gone")))
    scratch.keep_only(gone)
    same = F.col("doc_id").eqNullSafe(F.col("of"))
    if gone.count() <= MOST_BROADCAST:
        ids = F.broadcast(gone.select("of"))
        # Joined by a shuffle at every size, as lists of lines grow with the texts.
        joined = texts.join(ids, same, "left_semi").join(gone.hint("merge"), same).select("doc_id", "text", "gone")
        joined = joined.unionByName(texts.join(ids, same, "left_anti").withColumn("gone", F.lit(None).cast("array<binary>")))
    else:
        joined = texts.join(gone, same, "left").select("doc_id", "text", "gone")

    def rebuild(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines, dropped, out = [], [], []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = text.encode("utf-8").split(b"\n")
            if gone:
                hashes = set(gone)
                stay = [x for x in own if line_hash(x, min_chars) not in hashes]
            else:
                stay = own
            lines.append(len(own))
            dropped.append(len(own) - len(stay))
            out.append(text if len(stay) == len(own) else b"\n".join(stay).decode("utf-8"))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])

    return map_batches(joined, rebuild, "doc_id long, n_lines long, n_dropped long, text string")
