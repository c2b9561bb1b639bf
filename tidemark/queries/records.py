"""Queries of the store operators: orders as candidates, customers as streams, nations as streamers, line items as logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import store
from tidemark.queries.common import table


def _log_id():
    """A line item's place in its order's log: the line number, then part and price, as numbers repeat."""
    return F.col("l_linenumber").cast("long") * 10**18 + F.col("l_partkey") * 10**11 + F.round(F.col("l_extendedprice") * 100).cast("long")


_LOG_ID = "(CAST(l_linenumber AS BIGINT) * 1000000000000000000 + l_partkey * 100000000000 + CAST(round(l_extendedprice * 100) AS BIGINT))"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    o, c, n, li = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "lineitem"))
    candidates = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("stream_id"), F.col("o_totalprice").alias("score"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("double").alias("source_ts"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected").alias("status"))
    streams = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("streamer_id"), F.col("c_mktsegment").alias("mode"))
    streamers = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("login"))
    reviews = li.filter("l_returnflag = 'R'").select(_log_id().alias("id"), F.col("l_orderkey").alias("candidate_id"), F.when(F.col("l_linestatus") == "F", "approved").otherwise("rejected").alias("decision"), F.when(F.col("l_quantity") > 25, "boring").otherwise("too_long").alias("reason_code"), F.col("l_shipdate").alias("reviewed_at"))
    return candidates, streams, streamers, reviews


def candidate_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = store.review_queue(*_tables(spark, sf_dir), limit=200)
    return got.select("id", "stream_id", F.round("score", 2).alias("score"), "source_ts", "status", "stream_title", "mode", "streamer_login", "review_decision", "review_reason")


def export_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, streams, streamers, reviews = _tables(spark, sf_dir)
    got = store.export_reviews(reviews, candidates, streams, streamers)
    return got.select("candidate_id", "review_id", "decision", "reason_code", F.round("score", 2).alias("score"), "status", "stream_title", "streamer_login")


def topn_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.top_jobs(_tables(spark, sf_dir)[0], 20).select("id", F.round("score", 2).alias("score"), "source_ts")


def filtered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.list_candidates(_tables(spark, sf_dir)[0], status="approved", limit=100).select("id", F.round("score", 2).alias("score"), "status")


def approve_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("status", F.when(F.col("quality") == 1, "approved").otherwise("rejected"))
    return store.decision_stats(labels).withColumn("approve_rate", F.round("approve_rate", 6))


def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("decision", F.when(F.col("quality") == 1, "approved").otherwise("rejected"))
    joined = labels.join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("reason_code")), "doc_id")
    return store.rejection_reasons(joined)


def precision_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "rejected").otherwise("pending"))
    return store.precision_report(e, "props", ['"k": 1', '"k": 2']).withColumn("approve_rate", F.round("approve_rate", 6))


def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "lineitem").withColumn("id", _log_id())
    return store.revisions(log, ["l_orderkey"], "id", F.col("l_returnflag") == "R").select("l_orderkey", "id", "revision", "is_current")


def mirrored_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, _, _, reviews = _tables(spark, sf_dir)
    return store.record_review(candidates, reviews)[0].groupBy("status").agg(F.count("*").alias("n"))


def patched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders patched by their line items: the last positive discount, the last flag that is not ``N``."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(0.0).alias("discount"), F.col("o_orderstatus").alias("flag"))
    log = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), _log_id().alias("id"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("discount"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"))
    return store.patched(o, log, ["o_orderkey"], "id", ["discount", "flag"]).select("o_orderkey", F.round("discount", 2).alias("discount"), "flag")


def upserted_streamers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations known, market segments seen: five new logins after the known ids."""
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lower("n_name").alias("login"), F.col("n_name").alias("display_name"))
    seen = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("login"), F.col("c_name").alias("display_name"), F.col("c_custkey").alias("order"))
    return store.upsert_streamers(known, seen)


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = store.validate(table(spark, sf_dir, "lineitem"), {"l_returnflag": ("R", "A")}, ["l_shipdate"])[1]
    return bad.groupBy("rejected_because").agg(F.count("*").alias("n"))


def resolved_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer has a name ending in an even digit have a recording; the others are refused."""
    candidates, streams, streamers, _ = _tables(spark, sf_dir)
    even = F.col("title").rlike("[02468]$")
    ok, refused = store.resolve_jobs(candidates, streams.withColumn("media_path", F.when(even, F.concat(F.lit("/media/"), "title"))), streamers)
    return ok.select("id", "source_path", F.lit(None).cast("string").alias("problem")).unionByName(refused.select("id", "source_path", "problem"))


_T = f"""o AS (SELECT o_orderkey AS id, o_custkey AS stream_id, o_totalprice AS score, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))::DOUBLE AS source_ts,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status FROM orders),
r AS (SELECT {_LOG_ID} AS review_id, l_orderkey AS candidate_id, CASE l_linestatus WHEN 'F' THEN 'approved' ELSE 'rejected' END AS decision, CASE WHEN l_quantity > 25 THEN 'boring' ELSE 'too_long' END AS reason_code
  FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LOG_ID} DESC) = 1)"""

QUERIES = {f.__name__: f for f in (candidate_queue, export_flat, topn_jobs, filtered_candidates, approve_rate, rejection_reasons, precision_report, latest_revision, mirrored_status, patched_rows, upserted_streamers, rejected_rows, resolved_jobs)}
ORACLE_SQL = {
    "candidate_queue": f"WITH {_T} SELECT o.id, o.stream_id, round(o.score, 2) AS score, source_ts, status, c_name AS stream_title, c_mktsegment AS mode, n_name AS streamer_login, decision AS review_decision, reason_code AS review_reason FROM o JOIN customer ON c_custkey = stream_id JOIN nation ON n_nationkey = c_nationkey LEFT JOIN r ON r.candidate_id = o.id ORDER BY o.score DESC, source_ts, o.id LIMIT 200",
    "export_flat": f"WITH {_T} SELECT candidate_id, review_id, decision, reason_code, round(score, 2) AS score, status, c_name AS stream_title, n_name AS streamer_login FROM r JOIN o ON o.id = candidate_id JOIN customer ON c_custkey = stream_id JOIN nation ON n_nationkey = c_nationkey",
    "topn_jobs": f"WITH {_T} SELECT id, round(score, 2) AS score, source_ts FROM o ORDER BY o.score DESC, source_ts, id LIMIT 20",
    "filtered_candidates": f"WITH {_T} SELECT id, round(score, 2) AS score, status FROM o WHERE status = 'approved' ORDER BY o.score DESC, source_ts, id LIMIT 100",
    "approve_rate": "SELECT count(*) AS total, 0::BIGINT AS pending, count(*) FILTER (WHERE quality = 1) AS approved, count(*) FILTER (WHERE quality IS DISTINCT FROM 1) AS rejected, round(count(*) FILTER (WHERE quality = 1)::DOUBLE / count(*), 6) AS approve_rate FROM labels",
    "rejection_reasons": "SELECT source AS reason_code, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality IS DISTINCT FROM 1 AND source IS NOT NULL GROUP BY 1",
    "precision_report": """SELECT count(*) AS total, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'error')) AS pending, count(*) FILTER (WHERE event_type = 'purchase') AS approved, count(*) FILTER (WHERE event_type = 'error') AS rejected,
 round(count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE / nullif(count(*) FILTER (WHERE event_type IN ('purchase', 'error')), 0), 6) AS approve_rate, count(*) FILTER (WHERE lower(props) LIKE '%"k": 1%' OR lower(props) LIKE '%"k": 2%') AS keyword_rows FROM events""",
    "latest_revision": f"""WITH n AS (SELECT l_orderkey, {_LOG_ID} AS id, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LOG_ID}) AS revision FROM lineitem)
SELECT l_orderkey, id, CAST(revision AS INTEGER) AS revision, coalesce(revision = max(CASE WHEN l_returnflag = 'R' THEN revision END) OVER (PARTITION BY l_orderkey), FALSE) AS is_current FROM n""",
    "mirrored_status": f"WITH {_T} SELECT coalesce(decision, status) AS status, count(*) AS n FROM o LEFT JOIN r ON r.candidate_id = o.id GROUP BY 1",
    "patched_rows": f"""SELECT o_orderkey, round(coalesce(d, 0.0), 2) AS discount, coalesce(f, o_orderstatus) AS flag FROM orders LEFT JOIN (
 SELECT l_orderkey, arg_max(l_discount, {_LOG_ID}) FILTER (WHERE l_discount > 0) AS d, arg_max(l_returnflag, {_LOG_ID}) FILTER (WHERE l_returnflag <> 'N') AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "upserted_streamers": """WITH s AS (SELECT lower(trim(c_mktsegment)) AS login, arg_max(c_name, c_custkey) AS seen, min(c_custkey) AS first FROM customer GROUP BY 1), k AS (SELECT n_nationkey::BIGINT AS id, lower(n_name) AS login, n_name FROM nation)
SELECT id, login, coalesce(seen, n_name) AS display_name FROM k LEFT JOIN s USING (login)
UNION ALL SELECT (SELECT max(id) FROM k) + row_number() OVER (ORDER BY first, login), login, coalesce(seen, login) FROM s WHERE login NOT IN (SELECT login FROM k)""",
    "rejected_rows": "SELECT CASE WHEN l_shipdate IS NULL THEN 'l_shipdate is missing' ELSE 'l_returnflag may not be ' || l_returnflag END AS rejected_because, count(*) AS n FROM lineitem WHERE l_shipdate IS NULL OR l_returnflag NOT IN ('R', 'A') GROUP BY 1",
    "resolved_jobs": "SELECT o_orderkey AS id, CASE WHEN regexp_matches(c_name, '[02468]$') THEN '/media/' || c_name END AS source_path, CASE WHEN c_custkey IS NULL THEN 'stream is missing' WHEN NOT regexp_matches(c_name, '[02468]$') THEN 'stream has no media path' END AS problem FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
}
