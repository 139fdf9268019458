"""Exact duplicates by a stateful stream.

A stream over the files keeps one state row for each digest, in RocksDB and without a watermark, so
that none expires: how many rows had it, the stable identifier of the best row and where its content lies
(file and row). Spark combines equal digests before they are shuffled, so a text that a third of the rows share
costs one row for each task. The state is then read as a table. Rows of digests that were hit more than once
are compared with the bytes at the locator; those that differ, which only a digest collision can cause, are
grouped by their whole text.

Texts of rows that nothing repeats are never shuffled: digests that were hit are joined by broadcast, at most FEW of
them. Should there be more, those are broadcast that hold so many rows that no more than FEW can, and the others, none
of which is large, are joined by a shuffle. A text that many rows share is compared in groups of SPREAD rows, each
with its own copy of the original, so no task holds them all.

Built-in functions only. Null counts as empty, so all null and blank texts are equal. Of equal texts the row
with the most code points stays, then the smallest doc_id, then the first by file and row, so of
repeated rows exactly one is kept. A null doc_id comes first. An empty table gives no rows. Only doc_id and text are
read, so other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hubbub.llm.common import BLANKS, fresh_path, stage, whole_text

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


#: Hit digests that are broadcast, each with some 300 bytes, and rows that meet one copy of an original.
FEW, SPREAD = 100_000, 256


def normalised(text: Column) -> Column:
    return F.translate(whole_text(text), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _keyed(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = whole_text(F.col("text"))
    return docs.select(
        digest(normalised(F.col("text"))).alias("digest"), F.length(text).alias("points"), "doc_id",
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"), "text",
    )


def digest_state(spark: SparkSession, path: str, state_dir: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Bring the state in state_dir up to date with the files at path; state: digest, n, best.
    Run again after files were added, it reads only those."""
    session = spark.newSession()
    # a new session has the defaults, not what was set on this one
    same = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")}
    for key, value in (_STATE | same).items():
        session.conf.set(key, value)
    schema = spark.read.parquet(path).schema
    # as a pattern that matches path alone: a streaming source takes a single file only so
    rows = _keyed(session.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]"), digest)
    best = F.min(F.struct((-F.col("points")).alias("points"), "doc_id", "place")).alias("best")
    grouped = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best)
    writer = grouped.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
    query = writer.option("checkpointLocation", state_dir).start()
    query.awaitTermination()
    if not any(p["numInputRows"] for p in query.recentProgress) and spark.read.parquet(path).isEmpty():
        return spark.createDataFrame([], grouped.schema)
    state = session.read.format("statestore").load(state_dir)
    return state.select(F.col("key.digest").alias("digest"), F.col("value.*")).toDF("digest", "n", "best")


def _with_state(rows: DataFrame, state: DataFrame, few: int) -> DataFrame:
    """The rows of digests that were hit more than once, with n and best of their digest."""
    hits = state.where("n > 1")
    if hits.count() <= few:
        return rows.join(F.broadcast(hits), "digest")
    total = state.agg(F.sum("n")).first()[0]
    large = total // few + 1  # at most `few` digests have as many rows
    marked = rows.join(F.broadcast(hits.where(F.col("n") >= large)), "digest", "left")
    others = marked.where("n is null").drop("n", "best").join(hits.where(F.col("n") < large).hint("merge"), "digest")
    return marked.where("n is not null").unionByName(others)


def exact_duplicates(
    spark: SparkSession, path: str, *, state_dir: str | None = None, digest: Callable[[Column], Column] = sha256, few: int = FEW
) -> DataFrame:
    """One row for each row at path: doc_id, digest, keep_id, group_size, kept."""
    state = stage(digest_state(spark, path, state_dir or fresh_path(spark, "digest-state"), digest), "digests")
    rows = _with_state(_keyed(spark.read.parquet(path), digest), state, few)
    # the locator could be read alone, but one scan beats as many point reads as there are hits
    seen = rows.withColumn("text", normalised(F.col("text"))).withColumn("keeps", F.col("best.place") == F.col("place"))
    groups = F.ceil(F.col("n") / SPREAD).cast("int")
    seen = stage(seen.withColumn("group", F.pmod(F.xxhash64("place"), groups).cast("int")), "hits")
    originals = seen.where("keeps").select("digest", F.explode(F.sequence(F.lit(0), groups - 1)).alias("group"), F.col("text").alias("original"))
    same = F.col("text") == F.col("original")
    checked = seen.join(originals, ["digest", "group"]).withColumn("same", same).withColumn("text", F.when(~same, F.col("text")))
    checked = stage(checked.drop("original", "group"), "checked")
    odd = checked.where("not same")

    keep_id = F.col("best.doc_id").alias("keep_id")
    first = state.where("n = 1").select(F.col("best.doc_id").alias("doc_id"), "digest", keep_id, F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    usual = checked.where("same")
    if odd.isEmpty():  # no digest stands for two texts
        return first.unionByName(usual.select("doc_id", "digest", keep_id, F.col("n").alias("group_size"), F.col("keeps").alias("kept")))
    fewer = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("odd"))
    usual = usual.join(fewer, "digest", "left").select(
        "doc_id", "digest", keep_id, (F.col("n") - F.coalesce("odd", F.lit(0))).alias("group_size"), F.col("keeps").alias("kept")
    )
    order = F.struct((-F.col("points")).alias("points"), "doc_id", "place")
    groups = odd.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("top"))
    split = odd.join(groups, ["digest", "text"]).select(
        "doc_id", "digest", F.col("top.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("top.place") == F.col("place")).alias("kept")
    )
    return first.unionByName(usual).unionByName(split)
