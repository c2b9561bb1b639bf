"""Candidates, reviews and renders: queue, export, statistics, revisions, and writes as logs.

Tables are append-only facts; the current state of a row is derived: the last
value of each column by log order, the latest review, the newest revision.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import like_any
from tidemark.operators.sequences import numbered

#: Allowed values of enumerated columns (fixed values).
ENUMS = {
    "candidates.status": ("pending", "approved", "rejected"),
    "candidates.edit_status": ("unrendered", "rendering", "rendered", "failed"),
    "streams.mode": ("vod", "live"),
    "reviews.decision": ("approved", "rejected"),
    "renders.kind": ("plan", "rough", "final"),
    "renders.status": ("ok", "failed"),
}

#: Reasons a rejection may give (fixed values).
REJECTION_REASONS = ("false_alarm", "needs_context", "too_long", "boring", "unsafe", "bad_edit", "bad_captions", "other")

#: Columns of the flat export, in order (fixed values).
EXPORT_COLUMNS = (
    "review_id", "candidate_id", "decision", "reason_code", "notes", "reviewed_at", "source_ts", "score", "streamer_login",
    "stream_id", "mode", "vod_id", "status", "media_path", "caption", "extract_reason", "transcript",
)


def validate(table: DataFrame, enums: dict[str, Sequence[str]], required: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with ``rejected_because``): null in a required column, or a value that is not listed."""
    rules = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in required]
    rules += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.concat(F.lit(f"{c} may not be "), F.col(c).cast("string"))) for c, values in enums.items()]
    marked = table.withColumn("rejected_because", F.coalesce(*rules) if rules else F.lit(None).cast("string"))
    return marked.filter("rejected_because is null").drop("rejected_because"), marked.filter("rejected_because is not null")


def add_columns(table: DataFrame, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """Missing columns (name -> type, default) added, nulls of those with a default filled in."""
    for name, (kind, default) in wanted.items():
        value = F.lit(default).cast(kind)
        table = table.withColumn(name, value if name not in table.columns else F.col(name) if default is None else F.coalesce(F.col(name), value))
    return table


def list_candidates(candidates: DataFrame, ids: Sequence[int] = (), stream_id: int | None = None, status: str | None = None, limit: int = 200, score: str = "score", at: str = "source_ts", id_col: str = "id") -> DataFrame:
    """Candidates by score, then time; an empty ``ids`` is no filter."""
    out = candidates
    if ids:
        out = out.filter(F.col(id_col).isin(*ids))
    if stream_id is not None:
        out = out.filter(F.col("stream_id") == stream_id)
    if status is not None:
        out = out.filter(F.col("status") == status)
    return top_jobs(out, limit, score, at, id_col)


def top_jobs(jobs: DataFrame, limit: int, score: str = "score", at: str = "source_ts", id_col: str = "id") -> DataFrame:
    """The best ``limit`` jobs: score down, time up, id up; none if the limit is not positive."""
    return jobs.orderBy(F.desc(score), F.asc(at), F.asc(id_col)).limit(max(0, limit))


def review_queue(candidates: DataFrame, streams: DataFrame, streamers: DataFrame, reviews: DataFrame, limit: int | None = 200, status: str | None = None, stream_id: int | None = None) -> DataFrame:
    """Candidates with their stream, streamer and, where there is one, their latest review, best first."""
    c = candidates if status is None else candidates.filter(F.col("status") == status)
    c = c if stream_id is None else c.filter(F.col("stream_id") == stream_id)
    last = latest(reviews, ["candidate_id"], "id").select("candidate_id", F.col("decision").alias("review_decision"), F.col("reason_code").alias("review_reason"), F.col("reviewed_at"))
    out = c.join(streams.select(F.col("id").alias("stream_id"), F.col("title").alias("stream_title"), "streamer_id", "mode"), "stream_id").join(streamers.select(F.col("id").alias("streamer_id"), F.col("login").alias("streamer_login")), "streamer_id")
    out = out.join(last, out["id"] == last["candidate_id"], "left").drop("candidate_id")
    return out if limit is None else top_jobs(out, limit)


def export_reviews(reviews: DataFrame, candidates: DataFrame, streams: DataFrame, streamers: DataFrame) -> DataFrame:
    """Every review with its candidate, stream and streamer, by time of review."""
    c = candidates.select(F.col("id").alias("candidate_id"), *(x for x in candidates.columns if x != "id"))
    out = latest(reviews, ["candidate_id"], "id").withColumnRenamed("id", "review_id").join(c, "candidate_id")
    out = out.join(streams.select(F.col("id").alias("stream_id"), F.col("title").alias("stream_title"), "streamer_id", "mode"), "stream_id").join(streamers.select(F.col("id").alias("streamer_id"), F.col("login").alias("streamer_login")), "streamer_id")
    return out.orderBy("reviewed_at", "review_id")


def decision_stats(decided: DataFrame, status: str = "status", keys: Sequence[str] = ()) -> DataFrame:
    """Counts per status, and approvals among decided ones (null where none is)."""
    n = lambda v: F.count_if(F.col(status) == v)
    return decided.groupBy(*keys).agg(F.count("*").alias("total"), n("pending").alias("pending"), n("approved").alias("approved"), n("rejected").alias("rejected"), F.try_divide(n("approved").cast("double"), (n("approved") + n("rejected")).cast("double")).alias("approve_rate"))


def rejection_reasons(reviews: DataFrame, reason: str = "reason_code") -> DataFrame:
    return reviews.filter((F.col("decision") == "rejected") & F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason_code")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason_code")


def precision_report(decided: DataFrame, signals: str = "signals", phrases: Sequence[str] = ("clip it", '"keyword": "clip')) -> DataFrame:
    """Statistics with the number of rows whose signals, as lower-case JSON text, hold one of the phrases."""
    stats = decision_stats(decided)
    hits = decided.agg(F.count_if(like_any(F.lower(F.col(signals)), phrases)).alias("keyword_rows"))
    return stats.crossJoin(F.broadcast(hits))


def revisions(log: DataFrame, keys: Sequence[str] = ("candidate_id",), order: str = "id", current: Column | None = None) -> DataFrame:
    """Numbers a log per key and marks the newest row for which ``current`` holds (a final, successful render)."""
    w = Window.partitionBy(*keys).orderBy(order)
    good = (F.col("kind") == "final") & (F.col("status") == "ok") if current is None else current
    out = log.withColumn("revision", F.row_number().over(w))
    newest = F.max(F.when(good, F.col("revision"))).over(Window.partitionBy(*keys))
    return out.withColumn("is_current", F.coalesce(F.col("revision") == newest, F.lit(False)))


def newest_revisions(log: DataFrame, limit: int = 50, keys: Sequence[str] = ("candidate_id",), revision: str = "revision") -> DataFrame:
    """The newest ``limit`` rows of each key, by revision down; for one key, filter the log first."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(revision)))
    return log.withColumn("place", place).filter(F.col("place") <= max(0, limit))


def latest(log: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key, with partial aggregation rather than a window."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row")).select(*keys, "row.*")


def patched(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Rows after partial updates: for each column the last value given that is not null, else the base's."""
    last = changes.groupBy(*keys).agg(*(F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"new_{c}") for c in columns))
    out = base.join(last, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(f"new_{c}"), F.col(c)) for c in columns}).drop(*(f"new_{c}" for c in columns))


def upsert_streamers(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Streamers (id, login, display_name) after sightings (login, display_name, order): new logins get the next ids by first sighting."""
    norm = F.lower(F.trim("login"))
    seen = seen.select(norm.alias("login"), F.col("display_name").alias("seen_name"), "order").filter("login <> ''")
    grouped = seen.groupBy("login").agg(F.max_by("seen_name", F.when(F.col("seen_name").isNotNull(), F.col("order"))).alias("seen_name"), F.min("order").alias("first"))
    new = grouped.join(known.select("login"), "login", "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = numbered(new, ["first", "login"]).crossJoin(F.broadcast(top)).select((F.col("top") + F.col("number")).cast("long").alias("id"), "login", F.coalesce("seen_name", "login").alias("display_name"))
    old = known.join(grouped, "login", "left").select("id", "login", F.coalesce("seen_name", "display_name").alias("display_name"))
    return old.unionByName(fresh)


def record_review(candidates: DataFrame, reviews: DataFrame, reasons: Sequence[str] = REJECTION_REASONS) -> tuple[DataFrame, DataFrame]:
    """(candidates with the status of their latest review, rejected reviews).  A reason is checked only for rejections and dropped on approval."""
    bad = (F.col("decision") == "rejected") & (F.coalesce("reason_code", F.lit("")) != "") & ~F.col("reason_code").isin(*reasons) | ~F.col("decision").isin(*ENUMS["reviews.decision"])
    good = reviews.filter(~bad).withColumn("reason_code", F.when(F.col("decision") == "rejected", F.col("reason_code")))
    last = latest(good, ["candidate_id"], "id").select(F.col("candidate_id").alias("id"), F.col("decision").alias("new"))
    return candidates.join(last, "id", "left").withColumn("status", F.coalesce("new", "status")).drop("new"), reviews.filter(bad)


def resolve_jobs(candidates: DataFrame, streams: DataFrame, streamers: DataFrame, override: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(jobs with a media path, candidates without one and why)."""
    s = streams.select(F.col("id").alias("stream_id"), F.lit(True).alias("known"), "media_path", "streamer_id")
    j = candidates.join(s, "stream_id", "left").join(streamers.select(F.col("id").alias("streamer_id"), F.col("login").alias("streamer_login")), "streamer_id", "left")
    j = j.withColumn("source_path", F.coalesce(F.lit(override).cast("string"), F.when(F.col("media_path") != "", F.col("media_path"))))
    why = F.when(F.col("known").isNull(), "stream is missing").when(F.col("source_path").isNull(), "stream has no media path")
    j = j.withColumn("problem", why).drop("known", "media_path")
    return j.filter("problem is null").drop("problem"), j.filter("problem is not null")


def run_counters(outcomes: DataFrame, keys: Sequence[str], outcome: str = "outcome", known: Sequence[str] = ("done", "skipped", "failed")) -> DataFrame:
    """What a run did per key: rows ``seen``, one count for each known outcome, and ``other``."""
    is_known = F.coalesce(F.col(outcome).isin(*known), F.lit(False))
    return outcomes.groupBy(*keys).agg(F.count("*").alias("seen"), *(F.count_if(F.col(outcome) == k).alias(k) for k in known), F.count_if(~is_known).alias("other"))


def changed_inputs(rows: DataFrame, done: DataFrame, keys: Sequence[str], inputs: Sequence[str]) -> DataFrame:
    """Rows whose inputs have a fingerprint (``fingerprint``) that ``done`` does not hold for their key."""
    mark = F.sha2(F.to_json(F.struct(*inputs)), 256)
    return rows.withColumn("fingerprint", mark).join(done.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti")
