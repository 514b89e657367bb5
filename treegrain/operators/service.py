"""Service rules as DataFrame operators: users and tiers, daily quotas, indexes with a time to live, limits, result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: tier: vectors at most, queries a day (0: no limit), seconds that an index lives (0: for ever), bytes of an archive.
TIERS = [("free", 10_000, 50, 3600, 10 << 20), ("paid", 500_000, 0, 0, 200 << 20)]
CREATED, ENDED = ("subscription_created", "created"), ("subscription_deleted", "subscription_paused", "deleted", "paused")


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIERS, "tier string, max_vectors long, daily_queries long, ttl_seconds long, max_archive_bytes long")


def users_with_limits(users: DataFrame, limits: DataFrame) -> DataFrame:
    """users (user_id, tier, ...) with their tier's limits; the tiers are a handful of rows."""
    return users.join(F.broadcast(limits), "tier", "left")


def tier_changes(users: DataFrame, events: DataFrame) -> DataFrame:
    """users after ordered events (user_id, seq, kind): the last creation makes paid, the last deletion or pause free, others count for nothing."""
    change = F.when(F.col("kind").isin(*CREATED), "paid").when(F.col("kind").isin(*ENDED), "free")
    last = events.withColumn("__tier", change).where("__tier is not null").groupBy("user_id").agg(F.max_by("__tier", "seq").alias("__tier"))
    return users.join(last, "user_id", "left").withColumn("tier", F.coalesce("__tier", "tier")).drop("__tier")


def daily_usage(requests: DataFrame, *, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(user_id, day, n): requests by user and UTC day."""
    return requests.groupBy(F.col(user).alias("user_id"), F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def within_quota(requests: DataFrame, limit: int, *, user: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Requests with nth (their number in the user's UTC day) and allowed (nth <= limit; limit 0: always)."""
    nth = F.row_number().over(W.partitionBy(user, F.to_date(ts)).orderBy(ts, order)).cast("long")
    return requests.withColumn("nth", nth).withColumn("allowed", (F.col("nth") <= limit) | F.lit(limit == 0))


def expires_at(created: Column, ttl_seconds: Column) -> Column:
    """When an index put at `created` ends; null for a time to live of 0."""
    return F.when(ttl_seconds > 0, F.timestamp_micros(F.unix_micros(created.cast("timestamp")) + ttl_seconds * 1_000_000))


def live(indexes: DataFrame, now: Column) -> DataFrame:
    """Indexes that haven't expired: it takes a later moment than expires_at, an equal one doesn't do."""
    return indexes.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def put(indexes: DataFrame, new: DataFrame) -> DataFrame:
    """Catalog with entries (index_id, ...) replaced by new ones of the same id."""
    return indexes.join(new.select("index_id"), "index_id", "left_anti").unionByName(new, allowMissingColumns=True)


def drop(indexes: DataFrame, index_id: str) -> DataFrame:
    return indexes.where(F.col("index_id") != index_id)


def over_limits(n_vectors: int, archive_bytes: int, limits: dict) -> str | None:
    """What a new index breaks of its tier's limits, or None."""
    if archive_bytes > limits["max_archive_bytes"]:
        return f"archive has {archive_bytes} bytes, {limits['max_archive_bytes']} are allowed"
    if n_vectors > limits["max_vectors"]:
        return f"index has {n_vectors} vectors, {limits['max_vectors']} are allowed"
    return None


def summary(chunks: DataFrame, index_id: str) -> DataFrame:
    """One row: index_id, n_chunks, n_files, depth_distribution (map)."""
    depths = chunks.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("depth", "n")))).alias("depth_distribution"))
    counts = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("source_file").alias("n_files"))
    return counts.crossJoin(depths).select(F.lit(index_id).alias("index_id"), "n_chunks", "n_files", "depth_distribution")


def search_rows(results: DataFrame, corpus: DataFrame, *, characters: int = 1000) -> DataFrame:
    """Response rows (query_id, score_rank, node_path, depth, text, source_file): result rows in order, texts cut to what a response shows."""
    shown = corpus.select("id", "node_path", "depth", F.substring("text", 1, characters).alias("text"), "source_file")
    return results.select("query_id", "id", F.col("out_pos").alias("score_rank")).join(shown, "id").select("query_id", "score_rank", "node_path", "depth", "text", "source_file")


def check_request(query: str, k: int) -> None:
    """ValueError unless the query has 1 to 2000 characters and k lies between 1 and 50."""
    if not 1 <= len(query) <= 2000:
        raise ValueError("a query has 1 to 2000 characters")
    if not 1 <= k <= 50:
        raise ValueError("k lies between 1 and 50")


def search(requests: DataFrame, indexes: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """requests (request_id, user_id, index_id, ts) with the status a search would have: 429 over quota, 404 unknown or expired index, 403 another's index, 200.

    The quota counts first, as it is spent before the index is looked up.
    """
    limits = users_with_limits(users, tiers(requests.sparkSession)).select("user_id", "daily_queries")
    nth = F.row_number().over(W.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "request_id"))
    known = live(indexes, now).select("index_id", "owner")
    asked = requests.withColumn("__nth", nth).join(limits, "user_id", "left").join(known, "index_id", "left")
    status = F.when((F.col("daily_queries") > 0) & (F.col("__nth") > F.col("daily_queries")), 429).when(F.col("owner").isNull(), 404).when(F.col("owner") != F.col("user_id"), 403).otherwise(200)
    return asked.select("request_id", "user_id", "index_id", status.alias("status"))
