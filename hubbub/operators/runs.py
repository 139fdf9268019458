"""Collection runs: what to fetch next, and how a run ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubbub.operators.trend import days, instant


def incremental_window(runs: DataFrame, as_of: str, lookback_minutes: int = 15, first_days: int = 7) -> DataFrame:
    """From the end of the last successful window, looked back a little, or first_days ago."""
    done = F.max(F.when(F.col("status") == "success", F.col("window_end"))) - F.make_dt_interval(mins=F.lit(lookback_minutes))
    return runs.groupBy("source_key").agg(F.coalesce(done, instant(as_of) - days(first_days)).alias("since")).withColumn("until", instant(as_of))


def reap_stale(runs: DataFrame, as_of: str, hours: int = 6) -> DataFrame:
    stale = (F.col("status") == "running") & (F.col("started_at") < instant(as_of) - F.make_dt_interval(hours=F.lit(hours)))
    return runs.select("run_id", F.when(stale, "failed").otherwise(F.col("status")).alias("status"), F.when(stale, F.concat_ws("; ", "detail", F.lit("stale"))).otherwise(F.col("detail")).alias("detail"))


def run_status(steps: DataFrame) -> DataFrame:
    """steps: run_id, window, source_key, complete. Partial iff a window of a term is not complete."""
    parts = steps.groupBy("run_id", "window", "source_key").agg(F.bool_and("complete").alias("complete"))
    rows = parts.groupBy("run_id").agg(F.count_if(~F.col("complete")).alias("incomplete"))
    return rows.withColumn("status", F.when(F.col("incomplete") > 0, "partial").otherwise("success"))
