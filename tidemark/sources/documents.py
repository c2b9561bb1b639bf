"""Plans, subtitles and exports as documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as tx
from tidemark.operators.store import EXPORT_COLUMNS


def rounded(value: Column, kind: T.DataType, digits: int = 3) -> Column:
    """A value of any nested type with every floating number rounded."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.bround(value, digits)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(rounded(value[f.name], f.dataType, digits).alias(f.name) for f in kind)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: rounded(x, kind.elementType, digits))
    return value


def to_documents(rows: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Rows as JSON text, floating numbers at three digits."""
    names = columns or rows.columns
    return F.to_json(F.struct(*(rounded(F.col(c), rows.schema[c].dataType).alias(c) for c in names)), {"ignoreNullFields": "false"})


def from_documents(docs: DataFrame, schema: str, defaults: dict[str, object], text: str = "value") -> DataFrame:
    """Documents read tolerantly: missing or null fields take their defaults, unreadable text gives defaults only."""
    parsed = docs.withColumn("doc", F.from_json(text, schema)).drop(text)
    kinds = T.StructType.fromDDL(schema)
    field = lambda f: F.coalesce(F.col("doc")[f.name], F.lit(defaults[f.name]).cast(f.dataType)) if defaults.get(f.name) is not None else F.col("doc")[f.name]
    return parsed.select(*(c for c in parsed.columns if c != "doc"), *(field(f).alias(f.name) for f in kinds))


def subtitle_documents(cues: DataFrame, keys: Sequence[str], style: str = "Main", header: str = "[Events]\nFormat: Layer, Start, End, Style, Text", karaoke: bool = True, upper: bool = True) -> DataFrame:
    """One subtitle text per key: a header, then a dialogue line per cue in order."""
    shown = tx.karaoke(F.col("words"), upper) if karaoke else tx.ass_text(F.upper("text") if upper else F.col("text"))
    line = F.concat(F.lit("Dialogue: 0,"), tx.ass_time(F.col("start")), F.lit(","), tx.ass_time(F.col("end")), F.lit(f",{style},"), shown)
    lines = cues.select(*keys, "cue", line.alias("line")).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    return lines.select(*keys, F.concat(F.lit(header + "\n"), "lines").alias("document"))


def subtitle_preview(docs: DataFrame, keys: Sequence[str], most: int = 6, document: str = "document") -> DataFrame:
    """The first lines of subtitles without tags; (keys, lines)."""
    dialogue = F.filter(F.split(F.col(document), r"\r?\n"), lambda x: x.startswith("Dialogue:"))
    shown = F.transform(dialogue, lambda x: tx.plain_line(F.regexp_extract(x, r"^Dialogue:(?:[^,]*,){4}(.*)$", 1)))
    return docs.select(*keys, F.slice(F.filter(shown, lambda x: x != ""), 1, most).alias("lines"))


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def export_csv(rows: DataFrame, path: str, columns: Sequence[str] = EXPORT_COLUMNS) -> None:
    """A fixed projection with a header; missing columns are empty, others are left out."""
    rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns)).write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose files may differ by columns added later."""
    return spark.read.option("mergeSchema", "true").parquet(path)
