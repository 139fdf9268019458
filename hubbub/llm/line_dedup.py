"""Lines that many documents repeat, found by range-partitioned hashes.

Line hashes are dealt by range of (hash, doc_id), so that a line of a third of all documents spreads over
many partitions, and sorted within by hash, descending doc_id and position. A task streams its rows: the first
occurrence of a hash is the copy that stays, later documents lose theirs once enough documents hold it. A hash
whose run may go on in another partition is one of at most two for each partition; what is open about them is
settled afterwards from their first documents. What comes back is a compressed bitmap of the lines to keep for
each document that loses some, never text.

A line's key is the line without blanks at its ends and with A-Z lower-cased. Null and empty texts are one empty
line and lose nothing. Lines that repeat within one document count once. Rows with equal doc_id count as one
document and lose lines together. A row with a null doc_id is no document that could be told from others: it neither
counts towards the documents that hold a line nor loses any. Empty tables give no rows. Columns other than doc_id and text are not read
by the search; apply_bitmaps passes them through, but for those named like its two counts, which it replaces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from hubbub.llm.common import BLANKS, few_at_once, n_partitions, plain_names, stage, whole_text

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_hashes(docs: DataFrame, *, min_points: int) -> DataFrame:
    """h1, h2 (128 bits of the key), doc_id, line for each line whose key has min_points code points."""
    lines = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split(whole_text(F.col("text")), "\n")).alias("line", "text"))
    key = F.btrim(F.col("text"), F.lit(BLANKS))
    lines = lines.where(F.length("text") >= min_points).select("doc_id", "line", key.alias("key")).where(F.length("key") >= min_points)
    key = F.translate("key", _UPPER, _LOWER)
    return lines.select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"), "doc_id", "line")


def repeated_lines(hashes: DataFrame, *, min_docs: int) -> DataFrame:
    """doc_id, line of every line to drop."""

    def stream(batches):
        """(h1, h2, doc_id, line, open): lines to drop, and what is open until other partitions are known: all rows
        of the first run, and of the last one its rows or, if it was decided, its first documents."""
        run, first_run, undecided, firsts = None, True, [], []
        for batch in batches:
            out = []
            for h1, h2, doc, line in zip(*(batch[c].to_pylist() for c in ("h1", "h2", "doc_id", "line"))):
                if (h1, h2) != run:
                    first_run = run is None
                    run, undecided, firsts, last = (h1, h2), [], [], None
                if first_run:
                    out.append((h1, h2, doc, line, True))
                    continue
                if doc != last and len(firsts) < min_docs:
                    firsts.append(doc)
                last = doc
                if len(firsts) < min_docs:
                    undecided.append((doc, line))
                    continue
                out += [(h1, h2, d, x, False) for d, x in undecided if d != firsts[0]]
                undecided = []
                if doc != firsts[0]:
                    out.append((h1, h2, doc, line, False))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DROP)], schema=_DROP)
        if run and not first_run:
            out = [(*run, d, x, True) for d, x in undecided] or [(*run, d, -1, True) for d in firsts]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DROP)], schema=_DROP)

    # staged first: finding the ranges reads its input once more
    hashes = stage(hashes, "line-hashes")
    order = ("h1", "h2", F.col("doc_id").desc())
    dealt = hashes.repartitionByRange(n_partitions(hashes.sparkSession), *order).sortWithinPartitions(*order, "line")
    found = stage(dealt.mapInArrow(stream, "h1 long, h2 long, doc_id long, line int, open boolean"), "line-drops")
    still_open = found.where("open")
    by_doc = still_open.groupBy("h1", "h2", "doc_id").agg(F.lit(1))
    totals = by_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("first")).where(F.col("docs") >= min_docs)
    # at most two hashes for each partition, whatever the size of the corpus
    late = still_open.join(F.broadcast(totals), ["h1", "h2"]).where("doc_id <> first and line >= 0")
    return found.where("not open").select("doc_id", "line").unionByName(late.select("doc_id", "line"))


_DROP = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("open", pa.bool_())])


def _bitmap(lines: list[int]) -> bytes:
    """Bits of the lines to keep, whole bytes up to the last dropped one, deflated; lines after them stay."""
    keep = np.ones((max(lines) // 8 + 1) * 8, bool)
    keep[lines] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def keeps(bitmap: bytes | None, n: int) -> np.ndarray:
    """Which of n lines stay."""
    keep = np.ones(n, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), "u1"), bitorder="little")[:n].astype(bool)
        keep[: len(bits)] = bits
    return keep


def line_bitmaps(docs: DataFrame, *, min_points: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id and the bitmap of lines to keep, for documents that lose lines."""

    def bitmaps(batches):
        for batch in batches:
            maps = [_bitmap(lines) for lines in batch["lines"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(maps, pa.binary())], ["doc_id", "bitmap"])

    dropped = repeated_lines(line_hashes(docs, min_points=min_points), min_docs=min_docs)
    # at most as many as the document has lines
    lines = dropped.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    return lines.mapInArrow(bitmaps, "doc_id long, bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, into: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with the text that stays, and the numbers of lines and of dropped lines in the columns `into`."""
    columns, schema, names = plain_names(docs, ("text", *into))
    # one bitmap for each affected document grows with docs: it is never broadcast, so the plan is alike at every size
    rows = docs.select(*columns, F.col("doc_id").alias("own"), whole_text(F.col("text")).alias("text"))
    joined = rows.join(bitmaps.select(F.col("doc_id").alias("of"), "bitmap").hint("merge"), F.col("own") == F.col("of"), "left")
    schema = StructType([*schema, StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    def cut(batches):
        for batch in few_at_once(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, bitmap in zip(batch["text"].to_pylist(), batch["bitmap"].to_pylist()):
                n, dropped = text.count("\n") + 1, 0
                if bitmap is not None:
                    keep = keeps(bitmap, n).tolist()
                    dropped = n - sum(keep)
                    text = "\n".join([x for x, k in zip(text.split("\n"), keep) if k])
                texts.append(text)
                n_lines.append(n)
                n_dropped.append(dropped)
            found = [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *found], schema.names)

    return joined.select(*schema.names[: len(names)], "text", "bitmap").mapInArrow(cut, schema).toDF(*names, "text", *into)
