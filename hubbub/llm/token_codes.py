"""Token ids on disk as directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level k holds chunk k of every id that has one, a
bitmap that tells which of them go on at level k + 1, and a rank directory (set bits before each block of
512) that turns a position in one level into a position in the next. Any token is read from a few bytes
and one partial bit count for each level; no block is decoded.

A file row is a segment: whole documents in doc_id order with their starts. Parquet is only the
container, without compression: Spark writes it to any store, and a task that is lost leaves no part file.

Nulls and empty texts hold the end id alone. Rows with equal doc_id are ordered by a hash of their text, then
by the text. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubbub.llm.common import n_partitions, whole_text
from hubbub.llm.tokens import word_encoder

CHUNK_BITS = 8
RANK_BITS = 512

_LEVEL = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
_SEGMENT = pa.schema([
    ("shard", pa.int32()), ("segment", pa.int32()), ("start_in_shard", pa.int64()), ("n_tokens", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("levels", pa.list_(_LEVEL)),
])
SEGMENT_SCHEMA = (
    "shard int, segment int, start_in_shard long, n_tokens long, doc_ids array<long>, starts array<long>, "
    "levels array<struct<chunks: binary, more: binary, ranks: binary>>"
)


def encode_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    levels, rest = [], np.asarray(ids, "<u4")
    while True:
        higher = rest >> CHUNK_BITS
        more = higher > 0
        blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype="<u4") if len(more) else np.zeros(0, "<u4")
        ranks = np.concatenate([np.zeros(1, "<u4"), np.cumsum(blocks, dtype="<u4")])
        levels.append({"chunks": rest.astype("u1").tobytes(), "more": np.packbits(more, bitorder="little").tobytes(), "ranks": ranks.tobytes()})
        if not more.any():
            return levels
        rest = higher[more]


def decode_levels(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids of a segment."""
    ids = np.zeros(0, "<u4")
    for level in reversed(levels):
        here = np.frombuffer(level["chunks"], "u1").astype("<u4")
        if len(ids):
            more = np.unpackbits(np.frombuffer(level["more"], "u1"), count=len(here), bitorder="little").astype(bool)
            here[more] |= ids << CHUNK_BITS
        ids = here
    return ids


def token_at(levels: list[dict[str, bytes]], i: int) -> int:
    """Id number i of a segment, from a few bytes of each level."""
    out = 0
    for k, level in enumerate(levels):
        out |= level["chunks"][i] << (CHUNK_BITS * k)
        if not level["more"][i >> 3] >> (i & 7) & 1:
            break
        block = i // RANK_BITS
        before = level["more"][block * RANK_BITS // 8 : i >> 3]
        rank = int.from_bytes(level["ranks"][4 * block : 4 * block + 4], "little")
        rank += int.from_bytes(before, "little").bit_count() + (level["more"][i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        i = rank
    return out


def write_token_codes(
    docs: DataFrame, path: str, *, tokenizer_path: str, end_id: int = 0, segment_tokens: int = 1 << 18, shards: int | None = None
) -> None:
    """Encode docs (doc_id, text) and write them in ascending doc_id order, one shard for each range."""

    def segments(batches):
        encoder = word_encoder(tokenizer_path)
        shard, end = TaskContext.get().partitionId(), int(end_id).to_bytes(4, "little")
        doc_ids, parts, held, number, start = [], [], 0, 0, 0

        def segment():
            ids = np.frombuffer(b"".join(parts), "<u4")
            starts = np.cumsum([0] + [len(p) // 4 for p in parts])[:-1]
            row = {"shard": shard, "segment": number, "start_in_shard": start, "n_tokens": len(ids), "doc_ids": doc_ids, "starts": starts.tolist(), "levels": encode_levels(ids)}
            return pa.RecordBatch.from_pylist([row], _SEGMENT)

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.each(batch["text"])):
                doc_ids.append(doc_id)
                parts.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= segment_tokens:
                    yield segment()
                    doc_ids, parts, held, number, start = [], [], 0, number + 1, start + held
        if parts:
            yield segment()

    n = shards or n_partitions(docs.sparkSession)
    rows = docs.select("doc_id", whole_text(F.col("text")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranges = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    coded = ranges.select("doc_id", "text").mapInArrow(segments, SEGMENT_SCHEMA)
    coded.write.option("compression", "uncompressed").parquet(path)


def read_token_codes(spark: SparkSession, path: str) -> DataFrame:
    """The segments of written codes."""
    return spark.read.schema(SEGMENT_SCHEMA).parquet(path)


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit) of each document."""

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_levels(row["levels"])
                starts = row["starts"]
                cuts = [ids[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(ids)])]
                at = pa.array([row["start_in_shard"] + s for s in starts], pa.int64())
                shard = pa.array([row["shard"]] * len(cuts), pa.int32())
                yield pa.RecordBatch.from_arrays([shard, pa.array(row["doc_ids"], pa.int64()), at, pa.array(cuts, pa.binary())], ["shard", "doc_id", "at", "ids"])

    from pyspark.sql import Window as W

    ahead = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row for each shard
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    rows = segments.mapInArrow(documents, "shard int, doc_id long, at long, ids binary")
    # the number of shards is the number of write tasks, whatever the size of the corpus
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "ids")
