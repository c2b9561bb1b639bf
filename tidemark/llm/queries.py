"""The registered queries of the training-data operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, checks, dedup, jpeg, lines, minhash, packing, repair, repeats, secrets, sentencepiece, toxicity, trie, wordpiece
from tidemark.llm.common import table


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file, named by the package that ships them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_features(jpeg.media_columns(table(spark, sf_dir, "documents")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = toxicity.held_out_rows()
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out=held)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), toxicity.score(machine, docs, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), pre_token_pattern()))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, F.col("text"), tokenizer("byte_bpe_50k.tiktoken"), pre_token_pattern())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found")).select("doc_id", "found.*")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(table(spark, sf_dir, "documents"), width=4)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The tool that a plain dialogue calls with each user turn.
REPLY_SCHEMA = {
    "reply": {
        "required": ["text"],
        "properties": {
            "first": {"type": "boolean"},
            "style": {
                "type": "object",
                "required": ["tone"],
                "properties": {"length": {"type": "integer", "minimum": 0}, "marks": {"type": "array", "items": {"type": "number", "maximum": 40}}, "tone": {"type": "string", "enum": ["plain", "asking"]}},
                "additionalProperties": False,
            },
            "text": {"type": "string", "minLength": 1, "maxLength": 4000},
            "turn": {"type": "integer"},
        },
        "additionalProperties": False,
    }
}


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.link_calls(chat.reply_events(messages), REPLY_SCHEMA).drop("text")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_OP6_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""

_OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keep_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_OP10_SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN CAST(turn + 1 AS VARCHAR) WHEN 'assistant' THEN CAST(turn AS VARCHAR) END AS event_id
  FROM conversations),
c AS (SELECT conv_id, turn, event_id, CAST(CASE WHEN turn // 2 % 2 = 0 THEN turn + 3 ELSE turn - 5 END AS VARCHAR) AS need FROM m WHERE kind = 'call'),
r AS (SELECT conv_id, turn, event_id FROM m WHERE kind = 'result'),
walk AS (
  SELECT conv_id, event_id AS of_event, event_id, need, turn, NULL::BIGINT AS answered, 0 AS far FROM c
  UNION ALL
  SELECT w.conv_id, w.of_event, n.event_id, n.need, n.turn, r.turn, w.far + CASE WHEN r.turn IS NULL THEN 1 ELSE 2 END
  FROM walk w JOIN c n ON n.conv_id = w.conv_id AND n.event_id = w.need LEFT JOIN r ON r.conv_id = n.conv_id AND r.event_id = n.event_id),
places AS (SELECT conv_id, of_event, turn, far FROM walk UNION ALL SELECT conv_id, of_event, answered, far - 1 FROM walk WHERE answered IS NOT NULL),
p AS (SELECT conv_id, of_event, max({'turn': turn, 'far': far}) AS place FROM places GROUP BY ALL),
j AS (
  SELECT a.*, b.turn AS other, place,
         CASE WHEN a.kind = 'call' THEN CASE WHEN b.turn IS NULL THEN 'unanswered' ELSE 'linked' END
              WHEN a.kind = 'result' THEN CASE WHEN b.turn IS NULL THEN 'orphan' ELSE 'linked' END END AS link,
         length(a.text) - length(replace(a.text, '.', '')) AS stops, length(a.text) - length(replace(a.text, ',', '')) AS commas,
         CASE WHEN a.kind = 'call' THEN CASE WHEN greatest(length(a.text) - length(replace(a.text, '.', '')), length(a.text) - length(replace(a.text, ',', '')) + 0.5) > 40 THEN 'an item of style.marks is too large'
              WHEN (length(a.text) + 3) % 7 = 0 THEN 'style.tone is not allowed' WHEN length(a.text) < 1 THEN 'text is too short' WHEN length(a.text) > 4000 THEN 'text is too long' END END AS invalid
  FROM m a LEFT JOIN m b ON a.conv_id = b.conv_id AND a.event_id = b.event_id AND a.kind <> b.kind
  LEFT JOIN p ON p.conv_id = a.conv_id AND p.of_event = a.event_id)
SELECT conv_id, turn, role, kind, event_id, link, invalid,
       greatest(turn, coalesce(place.turn, turn)) AS order_turn,
       CAST(CASE WHEN place IS NULL OR place.turn < turn THEN 0 WHEN kind = 'call' THEN place.far ELSE place.far + 1 END AS INTEGER) AS order_level, FALSE AS cyclic,
       concat('{"arguments":', CASE WHEN kind = 'call' THEN concat('{"first":', turn = 0, ',"style":{"length":', length(text), ',"marks":[', stops, ',', commas, '.5],"tone":"', CASE WHEN (length(text) + 3) % 7 = 0 THEN 'loud' WHEN length(text) % 2 = 0 THEN 'asking' ELSE 'plain' END, '"},"text":', CAST(to_json(text) AS VARCHAR), ',"turn":', turn, '}') ELSE 'null' END,
              ',"content":', CASE WHEN kind = 'call' THEN 'null' ELSE CAST(to_json(text) AS VARCHAR) END,
              ',"conv":', conv_id, ',"id":', coalesce('"' || event_id || '"', 'null'), ',"kind":"', kind,
              '","link":', coalesce('"' || link || '"', 'null'), ',"role":', CAST(to_json(role) AS VARCHAR),
              ',"tool":', CASE WHEN kind = 'call' THEN '"reply"' ELSE 'null' END, ',"turn":', turn,
              ',"valid":', CASE WHEN kind = 'call' THEN CASE WHEN invalid IS NULL THEN 'true' ELSE 'false' END ELSE 'null' END, '}') AS json
FROM j
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_media, op3_token_counts, op4_toxicity, op5_packing, op6_exact_dedup, op7_secrets, op8_minhash, op9_line_dedup, op10_chat,
        op11_structure_repair, op12_substring_dedup, op13_prefix_trie, pipeline,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": _OP6_SQL, "op9_line_dedup": _OP9_SQL, "op10_chat": _OP10_SQL, "op11_structure_repair": checks.OP11, "op12_substring_dedup": checks.OP12, "op13_prefix_trie": checks.OP13,
}
