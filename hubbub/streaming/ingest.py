"""The incremental loop as a stream: choose the event time, drop repeats, keep window counts current, settle posts by timers.

Each call works off what is there (availableNow) and resumes from its checkpoint when called again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubbub.operators.content import resolve_published_at
from hubbub.sources.staging import staging_path


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder or a single Parquet file; the pattern that matches path alone is what a streaming source takes."""
    schema = spark.read.parquet(re.sub(_GLOB, r"\\\g<0>", path)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(re.sub(_GLOB, r"\\\g<0>", path[:-1]) + f"[{path[-1]}]")


#: Characters of a path that a pattern would take for its own.
_GLOB = r"[\\\[\]{}*?]"
#: State on disk, its changes logged with each batch: keys that never leave must not fill the executors' memory.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.numRecentProgressUpdates": "100000",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in RocksDB; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def repaired(stream: DataFrame, created: str, indexed: str) -> DataFrame:
    """published_at by the batch rule, before any watermark: one future or backdated clock must not move it."""
    clocks = {"created_at": F.col(created).cast("timestamp"), "indexed_at": F.col(indexed).cast("timestamp")}
    return resolve_published_at(stream.withColumns(clocks))


COUNTERS = "run_id string, batch long, fetched long, kept long, late long, first_at long, last_at long"


def ingest(stream: DataFrame, key: list[str], path: str, checkpoint: str, delay: str | None = "2 days") -> DataFrame:
    """Append each key's first row, and return the run's counters: for each batch the rows fetched, kept and too late, and
    their range of times; what is neither kept nor late was a repeat. With a delay the state stays bounded, and every row
    that comes later than that is dropped, first or not. Without one no row is ever late; the state holds every key."""
    spark = stream.sparkSession
    timed = stream.withWatermark("published_at", delay) if delay else stream
    micros = F.unix_micros(F.col("published_at").cast("timestamp"))
    timed = timed.observe("fetched", F.count(F.lit(1)).alias("n"), *(f(micros).alias(c) for f, c in ((F.min, "first_at"), (F.max, "last_at"))))
    rows = timed.dropDuplicatesWithinWatermark(key) if delay else timed.dropDuplicates(key)
    rows = rows.observe("kept", F.count(F.lit(1)).alias("n"))
    with state_on_disk(spark):
        query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        out = []
        for p in query.recentProgress:
            seen, kept = p.observedMetrics.get("fetched"), p.observedMetrics.get("kept")
            if seen is not None and seen.n:
                out.append((str(p.runId), p.batchId, seen.n, kept.n if kept else 0, sum(s.numRowsDroppedByWatermark for s in p.stateOperators), seen.first_at, seen.last_at))
    return spark.createDataFrame(out, COUNTERS).withColumns({c: F.timestamp_micros(c) for c in ("first_at", "last_at")})


def window_counts(stream: DataFrame, width: str, slide: str, by: str, path: str, checkpoint: str, delay: str | None = "2 days") -> None:
    """Counts of sliding or tumbling windows. Each batch writes the windows that it has changed under its own number,
    so a repeated batch overwrites itself. Without a delay every window stays open and no row is left out."""
    timed = stream.withWatermark("published_at", delay) if delay else stream
    counts = timed.groupBy(F.window("published_at", width, slide), by).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")
    each = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/of={number}")
    with state_on_disk(stream.sparkSession):
        counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()


def latest_counts(spark: SparkSession, path: str, by: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("start", "end", by).agg(F.max_by("n", "batch").alias("n"))


def run_ingest(spark: SparkSession, stream: DataFrame, key: list[str], delay: str | None = None) -> DataFrame:
    """A backfill: files come in any order of event time, so by default nothing is late."""
    out = staging_path(spark, "ingest")
    ingest(stream, key, f"{out}/rows", f"{out}/checkpoint", delay)
    return spark.read.parquet(f"{out}/rows")


def run_windows(spark: SparkSession, stream: DataFrame, width: str, slide: str, by: str, delay: str | None = None) -> DataFrame:
    """A backfill, as run_ingest."""
    out = staging_path(spark, "windows")
    window_counts(stream, width, slide, by, f"{out}/counts", f"{out}/checkpoint", delay)
    return latest_counts(spark, f"{out}/counts", by)


def settled_engagement(stream: DataFrame, by: str, path: str, checkpoint: str, hours: int = 24) -> None:
    """Posts, engagement and posts without any of each `by`, of rows that were collected at least so long after they were
    published. A row is looked at when it is collected, so nothing waits and the state is one row for each `by`."""
    engagement = F.col("like_count") + F.col("repost_count")
    settled = F.col("collected_at") - F.col("published_at") >= F.make_dt_interval(F.lit(0), F.lit(hours))
    counts = stream.where(settled & engagement.isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("n_settled"), F.sum(engagement).alias("engagement"), F.count_if(engagement == 0).alias("n_zero")
    )
    each = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/of={number}")
    with state_on_disk(stream.sparkSession):
        counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()


def run_settled(spark: SparkSession, stream: DataFrame, by: str, hours: int = 24) -> DataFrame:
    """A backfill: the last counts of each `by`."""
    out = staging_path(spark, "settled")
    settled_engagement(stream, by, f"{out}/counts", f"{out}/checkpoint", hours)
    last = F.max_by(F.struct("n_settled", "engagement", "n_zero"), "batch").alias("c")
    return spark.read.parquet(f"{out}/counts").groupBy(by).agg(last).select(by, "c.*")
