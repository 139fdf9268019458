"""Posts settle once their time is over: a timer of event time gives out what was last known of each.

The clock is the time of collection. A post waits in state, with its newest snapshot, until the watermark passes the end
of its time; then it is given out once. Later snapshots of it change nothing: a mark stays until `forget` is over too, so
the state holds the posts of that span and not all posts.

Posts are dealt into buckets. A bucket is one key with one value, a table of its posts, and one timer at the earliest time
that any of them waits for, so a batch costs each bucket that it touches a few calls to the state, whatever the number of posts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hubbub.sources.staging import staging_path
from hubbub.streaming.ingest import state_on_disk

SETTLED = "post_id long, author_id string, published_at timestamp, collected_at timestamp, engagement long"
#: A bucket's table: times are milliseconds; known tells an engagement of 0 from a NULL.
_POSTS = pa.schema([("post_id", pa.int64()), ("author_id", pa.string()), ("published", pa.int64()), ("collected", pa.int64()), ("engagement", pa.int64()), ("known", pa.bool_()), ("done", pa.bool_())])


def newest(rows: pd.DataFrame) -> pd.DataFrame:
    """A row for each post of `rows`, what is held before what is new: its newest snapshot, with the time of publication
    that came first. Equal times of collection keep the larger engagement; a post that is done stays as it is."""
    posts = rows.groupby("post_id", sort=False)
    rows = rows.assign(published=posts["published"].transform("first"))
    rows = rows[rows["done"] | ~posts["done"].transform("any")]
    return rows.sort_values(["collected", "engagement", "known"], ascending=False, kind="stable").drop_duplicates("post_id")


class Settling(StatefulProcessor):
    """Keyed by bucket."""

    def __init__(self, hours: int, forget_hours: int):
        self.wait, self.forget = hours * 3_600_000, forget_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "posts binary, timer long")

    def _read(self) -> tuple[pd.DataFrame, int | None]:
        if not self.held.exists():
            return _POSTS.empty_table().to_pandas(), None
        posts, timer = self.held.get()
        return pa.ipc.open_stream(bytes(posts)).read_all().to_pandas(), timer

    def _write(self, posts: pd.DataFrame, timer: int | None) -> None:
        """timer: the one that is still registered, if any."""
        if posts.empty:
            self.held.clear()
            return
        due = int((posts["published"] + self.wait + posts["done"] * self.forget).min())
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(posts, _POSTS, preserve_index=False)
        with pa.ipc.new_stream(sink, _POSTS) as writer:
            writer.write_table(table)
        self.held.update((sink.getvalue().to_pybytes(), timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._read()
        new = pd.concat(list(rows)).sort_values("collected", kind="stable").assign(done=False)[_POSTS.names]
        self._write(newest(pd.concat([held, new], ignore_index=True) if len(held) else new), timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        posts, _ = self._read()
        now = timerValues.getCurrentWatermarkInMs()
        over = ~posts["done"] & (posts["published"] + self.wait < now)
        out = posts[over]
        posts = posts.assign(done=posts["done"] | over)
        self._write(posts[~posts["done"] | (posts["published"] + self.wait + self.forget >= now)], None)
        at = lambda ms: pd.to_datetime(ms, unit="ms", utc=True)
        engagement = out["engagement"].astype("Int64").where(out["known"])
        if len(out):
            yield pd.DataFrame({"post_id": out["post_id"], "author_id": out["author_id"], "published_at": at(out["published"]), "collected_at": at(out["collected"]), "engagement": engagement})

    def close(self) -> None:
        pass


def settle(stream: DataFrame, path: str, checkpoint: str, hours: int = 24, forget_hours: int = 720, delay: str = "0 seconds", buckets: int = 4096) -> None:
    """Append each post's newest snapshot once `hours` have passed since it was published, by the clock of collection.
    stream: post_id, author_id, published_at, collected_at, engagement. Rows without a post or a time are left out.
    buckets: a task holds one bucket's posts at a time; the number is fixed for a checkpoint's life."""
    ms = lambda c: (F.unix_micros(F.col(c)) / 1000).cast("long")
    rows = stream.withColumns({c: F.col(c).cast("timestamp") for c in ("published_at", "collected_at")}).where("post_id is not null and published_at is not null and collected_at is not null")
    rows = rows.withWatermark("collected_at", delay)
    engagement = F.col("engagement").cast("long")
    rows = rows.select(F.col("post_id").cast("long").alias("post_id"), "author_id", "collected_at", ms("published_at").alias("published"), ms("collected_at").alias("collected"),
                       F.coalesce(engagement, F.lit(0)).alias("engagement"), engagement.isNotNull().alias("known"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("post_id"), F.lit(buckets)))
    out = rows.groupBy("bucket").transformWithStateInPandas(Settling(hours, forget_hours), SETTLED, "Append", "EventTime")
    with state_on_disk(stream.sparkSession):
        out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_settle(spark: SparkSession, stream: DataFrame, hours: int = 24) -> DataFrame:
    """A backfill: what has settled by the latest time of collection."""
    out = staging_path(spark, "settling")
    settle(stream, f"{out}/rows", f"{out}/checkpoint", hours)
    return spark.read.schema(SETTLED).parquet(f"{out}/rows")
