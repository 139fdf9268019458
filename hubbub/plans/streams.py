"""Streams over the events file; their twins are the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubbub.plans.adapters import Tables
from hubbub.plans.catalog import register
from hubbub.sources.staging import staging_path
from hubbub.streaming import ingest as s
from hubbub.streaming import settling

_LATE = "CASE WHEN event_id % 50 = 0 THEN ts + INTERVAL '40' DAY WHEN event_id % 50 = 1 THEN ts - INTERVAL '9' DAY ELSE ts END"


def clocks(t):
    rows = s.read_stream(t.spark, f"{t.sf_dir}/events.parquet")
    return s.repaired(rows.withColumn("claimed", F.expr(_LATE)), "claimed", "ts")


def repeated(t):
    """Every tenth event arrives twice."""
    times = F.when(F.col("event_id") % 10 == 0, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return clocks(t).withColumn("copy", F.explode(times))


register("stream_ingest", lambda t: s.run_ingest(t.spark, repeated(t), ["event_id"]).select("event_id", "event_type"), "SELECT event_id, event_type FROM events")
register("stream_topic_windows", lambda t: s.run_windows(t.spark, clocks(t), "1 day", "1 day", "event_type").select(F.to_date("start").alias("day"), "event_type", "n"), "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
register("stream_sliding_windows", lambda t: s.run_windows(t.spark, clocks(t), "2 days", "1 day", "event_type").select(F.to_date("start").alias("day"), "event_type", "n"), """SELECT CAST(ts AS DATE) - CAST(x AS INTEGER) AS day, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS x) GROUP BY 1, 2""")
register("stream_late_repair", lambda t: s.run_ingest(t.spark, clocks(t), ["event_id"]).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("published_at") == F.col("indexed_at")).alias("indexed")), "SELECT CASE event_id % 50 WHEN 0 THEN 'future_createdAt' WHEN 1 THEN 'backdated_createdAt' END AS reason, count(*) AS n, count(*) AS indexed FROM events GROUP BY 1")


def post_stream(t):
    """The adapted posts over the events as a stream."""
    own = Tables(t.spark, t.sf_dir)
    own._made["events"] = s.read_stream(t.spark, f"{t.sf_dir}/events.parquet")
    return own.posts


register("stream_settled_engagement", lambda t: s.run_settled(t.spark, post_stream(t), "author_id"), """SELECT author_id, count(*) AS n_settled, CAST(sum(like_count + repost_count) AS BIGINT) AS engagement,
      count(*) FILTER (like_count + repost_count = 0) AS n_zero FROM posts WHERE collected_at - published_at >= INTERVAL 24 HOUR AND like_count + repost_count IS NOT NULL GROUP BY 1""")


def snapshots(t):
    return post_stream(t).select("post_id", "author_id", "published_at", "collected_at", (F.col("like_count") + F.col("repost_count")).alias("engagement"))


register(
    "stream_settled_posts", lambda t: settling.run_settle(t.spark, snapshots(t), hours=240).select("post_id", "author_id", "engagement"),
    """SELECT post_id, author_id, CAST(like_count + repost_count AS BIGINT) AS engagement FROM posts
      WHERE epoch_ms(published_at) + 864000000 < (SELECT max(epoch_ms(collected_at)) FROM posts)""",
)


def counted_run(t):
    """The counters of one backfill, over its batches."""
    out = staging_path(t.spark, "ingest")
    rows = s.ingest(repeated(t), ["event_id"], f"{out}/rows", f"{out}/checkpoint", None)
    return rows.agg(F.sum("fetched").alias("fetched"), F.sum("kept").alias("kept"), F.sum("late").alias("late"), F.min("first_at").cast("timestamp_ntz").alias("first_at"), F.max("last_at").cast("timestamp_ntz").alias("last_at"))


register("stream_run_counters", counted_run, "SELECT count(*) + count(*) FILTER (event_id % 10 = 0) AS fetched, count(*) AS kept, 0 AS late, min(ts) AS first_at, max(ts) AS last_at FROM events")
