"""Service and streaming queries over the driver's tables, with the SQL they are compared to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from treegrain.operators import service
from treegrain.operators.chunk_text import chunk_text
from treegrain.operators.chunks import hierarchy_warnings
from treegrain.plans import search
from treegrain.session import shared_dir, table
from treegrain.streaming import live

LIMIT = 2
NOW = "2024-01-20 00:00:00"


def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.daily_usage(table(spark, sf_dir, "events"))


def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's number in its user's day, and whether two a day would have allowed it."""
    return service.within_quota(table(spark, sf_dir, "events"), LIMIT).select("event_id", "user_id", "nth", "allowed")


def _indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups put an index that lives for as many hours as the event's value says, for ever for values under 10."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    ttl = F.when(F.col("value") >= 10, F.floor(F.col("value")) * 3600).otherwise(0)
    return e.select(F.concat(F.lit("i"), F.col("event_id").cast("string")).alias("index_id"), F.col("user_id").alias("owner"), "event_id", F.col("ts").alias("created_at")).join(e.select("event_id", ttl.alias("ttl")), "event_id").withColumn("expires_at", service.expires_at(F.col("created_at"), F.col("ttl")))


def ttl_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.live(_indexes(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("index_id", "owner")


def tier_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' tiers after their purchases (paid) and errors (free), in order."""
    e = table(spark, sf_dir, "events")
    users = e.select("user_id").distinct().withColumn("tier", F.lit("free"))
    kind = F.when(F.col("event_type") == "purchase", "created").when(F.col("event_type") == "error", "deleted").otherwise(F.col("event_type"))
    return service.tier_changes(users, e.select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"))).select("user_id", "tier")


def search_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search of each click event would have answered: over the quota, unknown index, another's, or fine."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    users = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("tier", F.when(F.col("user_id") % 2 == 0, "free").otherwise("paid"))
    indexes = users.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("_main")).alias("index_id"), F.col("user_id").alias("owner"), F.lit(None).cast("timestamp").alias("expires_at")).where("owner % 5 != 0")
    asked = e.select(F.col("event_id").alias("request_id"), "user_id", F.concat(F.lit("u"), (F.col("user_id") - F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)).cast("string"), F.lit("_main")).alias("index_id"), "ts")
    return service.search(asked, indexes, users, F.lit(NOW).cast("timestamp")).select("request_id", "status")


def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, files and depths of the documents' index."""
    s = service.summary(chunk_text(table(spark, sf_dir, "documents")), "documents_main")
    return s.select("index_id", "n_chunks", "n_files", F.col("depth_distribution")[0].alias("roots"), F.col("depth_distribution")[1].alias("paragraphs"))


def index_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy_warnings(chunk_text(table(spark, sf_dir, "documents")))


def search_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response rows of BM25 searches, texts cut to 1000 characters."""
    found = search.bm25_top10(spark, sf_dir).select("query_id", F.col("doc_id").alias("id"), F.col("rank").alias("out_pos"))
    corpus = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node_path"), F.lit(0).alias("depth"), "text", F.col("source").alias("source_file"))
    return service.search_rows(found, corpus)


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by user and day, counted by a stream over the events and written out as it goes."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = live.daily_counts(events, late="60 days")
    query = counts.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{at}/out/batch={n}")).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("user_id long, day date, n long").parquet(f"{at}/out").groupBy("user_id", "day").agg(F.max("n").alias("n"))


QUERIES = {f.__name__: f for f in (daily_usage, daily_quota, ttl_active, tier_changes, search_status, index_summary, index_warnings, search_response, stream_daily_counts)}

_USAGE = "SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL"
ORACLE_SQL = {
    "daily_usage": _USAGE,
    "daily_quota": f"SELECT event_id, user_id, nth, nth <= {LIMIT} AS allowed FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS nth FROM events)",
    "ttl_active": f"SELECT 'i' || event_id AS index_id, user_id AS owner FROM events WHERE event_type = 'signup' AND (value < 10 OR ts + to_hours(floor(value)::BIGINT) >= TIMESTAMP '{NOW}')",
    "tier_changes": "SELECT user_id, coalesce(arg_max(CASE event_type WHEN 'purchase' THEN 'paid' ELSE 'free' END, event_id) FILTER (event_type IN ('purchase', 'error')), 'free') AS tier FROM events GROUP BY user_id",
    "search_status": """WITH users AS (SELECT DISTINCT user_id FROM events), asked AS (SELECT event_id AS request_id, user_id, user_id - CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS of, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS nth FROM events WHERE event_type = 'click')
SELECT request_id, CASE WHEN a.user_id % 2 = 0 AND nth > 50 THEN 429 WHEN u.user_id IS NULL THEN 404 WHEN u.user_id <> a.user_id THEN 403 ELSE 200 END AS status FROM asked a LEFT JOIN (SELECT * FROM users WHERE user_id % 5 <> 0) u ON u.user_id = a.of""",
    "search_response": f"WITH {search._bm25_sql(10)} SELECT query_id, rank AS score_rank, 'd' || l.doc_id AS node_path, 0 AS depth, substr(d.text, 1, 1000) AS text, source AS source_file FROM lexical l JOIN documents d USING (doc_id)",
    "stream_daily_counts": _USAGE,
}
from treegrain.plans.corpus import _SENTENCES  # noqa: E402

ORACLE_SQL["index_summary"] = f"WITH RECURSIVE {_SENTENCES} SELECT 'documents_main' AS index_id, count(*) AS n_chunks, 1::BIGINT AS n_files, count(*) FILTER (depth = 0) AS roots, count(*) FILTER (depth = 1) AS paragraphs FROM chunks"
ORACLE_SQL["index_warnings"] = f"WITH RECURSIVE {_SENTENCES} SELECT CASE WHEN count(*) = 0 THEN 'no chunks' WHEN count(DISTINCT depth) = 1 AND max(depth) > 0 THEN 'a single tier, deeper than the root' END AS warning FROM chunks"
