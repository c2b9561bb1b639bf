"""Chat: JSON files of several shapes, line protocol, writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys under which a message's fields stand, first found first (fixed values).
TIME_KEYS = ("ts", "offset_seconds", "content_offset_seconds", "contentOffsetSeconds")
USER_KEYS = ("user", "username", "commenter")
TEXT_KEYS = ("text", "body", "message")


def _variant(item: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(item, f"$.{key}", kind)


def _truthy(item: Column, keys: tuple[str, ...], nested: tuple[str, ...]) -> Column:
    """The first of the keys that is not empty; an object gives its first nested field that is not empty."""
    found = []
    for key in keys:
        inner = [F.when(_variant(item, f"{key}.{n}", "string") != "", _variant(item, f"{key}.{n}", "string")) for n in nested]
        plain = F.when(~F.schema_of_variant(_variant(item, key, "variant")).startswith("OBJECT"), _variant(item, key, "string"))
        found += [*inner, F.when(plain != "", plain)]
    return F.coalesce(*found)


def parse_messages(items: DataFrame, item: str = "item", strict: bool = True) -> DataFrame:
    """Variant messages as (ts, user, text, emotes); one without a time raises, or is dropped if not ``strict``."""
    v = F.col(item)
    ts = F.coalesce(*(_variant(v, k, "double") for k in TIME_KEYS))
    out = items.withColumn("ts", ts).withColumn("user", F.coalesce(_truthy(v, USER_KEYS, ("display_name", "name")), F.lit("unknown"))).withColumn("text", F.coalesce(_truthy(v, TEXT_KEYS, ("body", "text")), F.lit(""))).withColumn("emotes", _variant(v, "emotes", "array<string>"))
    if strict:
        return out.withColumn("ts", F.when(F.col("ts").isNull(), F.raise_error(F.lit("a message without a time")).cast("double")).otherwise(F.col("ts"))).drop(item)
    return out.filter("ts is not null").drop(item)


def read_chat_json(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Messages of JSON files: a list, an object with ``comments`` or ``messages``, or an object a line; (file, seq, ts, user, text, emotes).

    A file is one document; it is split on the executors.  What ``write_chat_json`` writes is read back as it was.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return parse_messages(document_items(files, strict), strict=strict).withColumn("seq", F.col("seq").cast("long"))


def document_items(documents: DataFrame, strict: bool = True) -> DataFrame:
    """Documents (``value`` and further columns) as their messages: (further columns, seq, item)."""
    docs = documents.withColumn("doc", F.try_parse_json("value"))
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike(r"\S"))
    by_line = F.when(F.forall(lines, lambda x: F.try_parse_json(x).isNotNull()), F.transform(lines, F.try_parse_json))
    is_message = F.coalesce(*(F.try_variant_get("doc", f"$.{k}", "double") for k in TIME_KEYS)).isNotNull()
    root = F.coalesce(
        F.try_variant_get("doc", "$", "array<variant>"), F.try_variant_get("doc", "$.comments", "array<variant>"), F.try_variant_get("doc", "$.messages", "array<variant>"),
        F.when(is_message, F.coalesce(by_line, F.array("doc"))),  # a document is read up to the end of its first value
    )
    if strict:
        root = F.coalesce(root, F.when(F.col("value").rlike(r"\S"), F.raise_error(F.lit("neither a list nor an object with comments or messages"))).cast("array<variant>"))
    return docs.select(*(c for c in documents.columns if c != "value"), F.posexplode(root).alias("seq", "item"))


def write_chat_json(messages: DataFrame, path: str) -> None:
    """One object of ts, user, text and emotes on each line, files as large as the rows' partitions; ``read_chat_json`` reads them."""
    messages.select("ts", "user", "text", "emotes").write.mode("overwrite").json(path)


def parse_lines(lines: DataFrame, line: str = "value", at: str = "received", origin: Column | None = None) -> DataFrame:
    """Messages of a chat line protocol (``[@tags ]:user!host PRIVMSG #channel :text``); other lines are dropped.

    ``ts`` is the time of receipt less ``origin``.
    """
    bare = F.regexp_replace(F.rtrim(line), r"^@\S+ ", "")
    user, text = F.regexp_extract(bare, r"^:([^!\s]+)!\S* PRIVMSG ", 1), F.regexp_extract(bare, r"^:\S+ PRIVMSG \S+ :(.*)$", 1)
    good = bare.rlike(r"^:[^!\s]+!\S* PRIVMSG \S+ :")
    ts = F.col(at).cast("double") - (F.lit(0.0) if origin is None else origin)
    return lines.filter(good).withColumns({"ts": ts, "user": user, "text": text}).select("ts", "user", "text", *(c for c in lines.columns if c not in (line, at, "ts", "user", "text")))
