"""A corpus from documents to packed sequences: toxicity, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last
return the columns of ``documents``, and any further ones that are there, under
their own names; those take no part in a decision.  Empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import dedup, minhash, packing, secrets, toxicity
from tidemark.llm.common import Scratch, small_batches, table
from tidemark.llm.queries import pre_token_pattern, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model is fitted on the labelled rows of the same corpus.

    A null text is scored as an empty one; repeated rows score alike, each for
    itself; very long texts are scored whole.  Without labels of both classes
    every score is the share of toxic ones.
    """
    small_batches(spark)
    machine = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=toxicity.held_out_rows())
    return docs.filter(toxicity.score(machine, docs, F.col("text")) < toxicity.THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id, a null one being the smallest.

    A null text equals an empty one; of rows with equal id and text one stays.
    """
    return dedup.keep_first(docs, dedup.exact_duplicates(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, 0.8), the document with the smallest doc_id.

    Rows without doc_id, and rows without words (null and empty texts too), are
    in no component and stay.  Rows of one doc_id are one document.
    """
    gone = minhash.near_components(docs, width=5).filter(~F.col("kept")).select("doc_id").distinct()
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return dedup.drop_rows(docs.filter(worded), gone).unionByName(docs.filter(~worded))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark; n_chars follows.

    Null texts stay null; repeated rows are masked alike, very long texts whole.
    """
    small_batches(spark)
    clean = secrets.redact(docs, F.col("text"), tokenizer("byte_bpe_50k.tiktoken"), pre_token_pattern())
    out = docs.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1,024 tokens; a null text is an empty one, repeated rows are packed each, long ones are cut."""
    return packing.pack(packing.pieces(docs, tokenizer("byte_bpe_50k.json"), pre_token_pattern()))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("secrets", mask_secrets), ("packing", pack)]

#: SQL cannot express the fitted scores, the tokenizer or the packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.keep_only(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
