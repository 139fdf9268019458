"""Is collection working? Every job takes as_of, none reads the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubbub.operators.descriptive import gaps
from hubbub.operators.trend import in_window, instant

BAD = ("failed", "partial")


def last_success(runs: DataFrame, as_of: str) -> DataFrame:
    rows = runs.groupBy("source_key").agg(F.max(F.when(F.col("status") == "success", F.col("window_end"))).alias("last_success"))
    return rows.withColumn("age_hours", F.round(F.timestamp_diff("SECOND", F.col("last_success"), instant(as_of)) / 3600, 6))


def daily_runs(runs: DataFrame, as_of: str, w: int = 7) -> DataFrame:
    rows = runs.where(in_window(F.col("started_at"), as_of, w)).groupBy(F.to_date("started_at").alias("day"))
    return rows.pivot("status", ["success", "partial", "failed", "running"]).agg(F.count(F.lit(1))).na.fill(0)


def error_rate(runs: DataFrame) -> DataFrame:
    bad = F.count_if(F.col("status").isin(*BAD))
    return runs.groupBy("source_key").agg(F.count(F.lit(1)).alias("runs"), bad.alias("degraded"), F.round(bad / F.count(F.lit(1)), 6).alias("degraded_share"))


def data_health(posts: DataFrame, runs: DataFrame, since: str, until: str) -> DataFrame:
    bad = runs.agg(F.count_if(F.col("status").isin(*BAD)).alias("bad_runs"))
    missing = gaps(posts, since, until).agg(F.count(F.lit(1)).alias("gap_days"))
    inside = posts.where((F.col("published_at") >= instant(since)) & (F.col("published_at") < instant(until)))
    modes = inside.join(runs.select("run_id", "mode"), "run_id").agg(F.countDistinct("mode").alias("modes"), F.count(F.lit(1)).alias("posts"))
    # one row each
    rows = bad.crossJoin(F.broadcast(missing)).crossJoin(F.broadcast(modes))
    return rows.withColumn("has_problem", (F.col("bad_runs") > 0) | (F.col("gap_days") > 0) | (F.col("modes") > 1))


def source_status(configured: DataFrame, stats: DataFrame) -> DataFrame:
    return configured.join(stats, "source_key", "left").select("source_key", "enabled", F.coalesce("posts", F.lit(0)).cast("long").alias("posts"), "last_at")
