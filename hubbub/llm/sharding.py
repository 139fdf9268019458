"""Shards of near equal bytes by a minimax contiguous partition.

Documents of equal text form an atomic group. Groups, in order of their smallest doc_id, are cut into runs, one for
each shard, so that the largest run is as small as it can be: the smallest feasible capacity is found by binary search,
each candidate being checked greedily. A group larger than an even share of what is left gets a shard of its own, at the
end; else a text with very many copies would set the capacity for all, and greedy runs of that capacity leave shards
empty.

The running sum of all groups is a table, not a driver's list. The search reads a summary of it: the sum at every s-th
group. With these alone the greedy check is a lower bound (a run may only end at a known place) and an upper bound (it
may end anywhere within a gap). Both bound the capacity; while they differ, the gaps that the greedy ends lie in are
read with a smaller s, so a few reads of SUMMARY rows give the exact capacity for any number of groups. Runs then end as
near to even shares as the capacity allows, so the slack does not gather in the last shard.

A shard's rows are numbered from 0 in order of (doc_id, text hash) across many tasks: by range partitions, and the
rows of that shard in the partitions before.

Built-in functions only; the driver holds the summary and one row for each range partition. Texts are known by a
64-bit hash: should two collide, they go together, which every law allows. Null and empty texts are equal and count 16
bytes. A null doc_id is below all others. Repeated rows are rows of their own. Fewer groups than shards leave shards
empty; an empty table gives no rows. Columns other than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubbub.llm.common import n_partitions, stage, whole_text

#: Rows of the running sum that the driver holds at first, and that each refinement adds at most.
SUMMARY = 1 << 16
#: Uncertain ends of runs grow with the square of the number of shards; beyond this the summary is too coarse.
MOST_SHARDS = 2000
#: Bytes that a document takes besides its text.
EXTRA = 16
_ROW = (1 << 33) - 1


class Sums:
    """What is known of a running sum over `count` groups: (number, sum) of some of them, the last one always."""

    def __init__(self, rows: list[tuple[int, int]]):
        rows = sorted(set(rows))
        self.numbers, self.sums = [n for n, _ in rows], [s for _, s in rows]
        self.total = self.sums[-1]

    def gap(self, i: int) -> int:
        """Groups after the known place i - 1, up to the known place i."""
        return self.numbers[i] - (self.numbers[i - 1] if i else -1)

    def open(self, i: int) -> bool:
        """Whether groups end between the known places i - 1 and i."""
        return self.gap(i) > 1

    def ends(self, capacity: int, shards: int, anywhere: bool) -> list[int]:
        """Where greedy runs end; anywhere: in a gap with unknown ends, at its best place."""
        at, out = 0, []
        for _ in range(shards):
            i = bisect_right(self.sums, at + capacity)
            known = self.sums[i - 1] if i else 0
            at = at + capacity if anywhere and i < len(self.sums) and self.open(i) else max(at, known)
            out.append(min(at, self.total))
        return out

    def capacity(self, shards: int, anywhere: bool) -> int:
        """The smallest with which greedy runs reach the end."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            if self.ends(mid, shards, anywhere)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def unclear(self, shards: int, low: int, high: int) -> list[tuple[int, int]]:
        """Ranges of numbers whose sums decide between the capacities low and high."""
        gaps: set[int] = set()
        for a, b in zip(self.ends(low, shards, False), self.ends(high, shards, True)):
            i, j = bisect_right(self.sums, a), min(bisect_right(self.sums, b), len(self.sums) - 1)
            gaps.update(g for g in range(i, j + 1) if self.open(g))
        out: list[tuple[int, int]] = []
        for g in sorted(gaps):
            first, last = (self.numbers[g - 1] + 1 if g else 0), self.numbers[g]
            if out and out[-1][1] + 1 >= first:
                out[-1] = out[-1][0], last
            else:
                out.append((first, last))
        return out

    def cuts(self, shards: int, capacity: int) -> list[int]:
        """Ends of all runs but the last, none larger than capacity, each as near to an even share as that allows."""
        earliest, at = [], self.total
        for _ in range(shards - 1):
            i = bisect_left(self.sums, at - capacity)
            at = 0 if at <= capacity else self.sums[i]
            earliest.append(at)
        out, at = [], 0
        for k, least in enumerate(reversed(earliest), 1):
            even = at + (self.total - at) // (shards - k + 1)
            i = bisect_right(self.sums, even)
            near = min((self.sums[j] for j in (i - 1, i) if 0 <= j < len(self.sums)), key=lambda s: abs(s - even))
            last = bisect_right(self.sums, at + capacity)
            most = max(at, self.sums[last - 1]) if last else at
            at = min(max(near, least, at), most)
            out.append(at)
        return out


def numbered(df: DataFrame, order: list, within: list[str], label: str) -> DataFrame:
    """df staged in global order with `part`, a range partition, and `at`, the row's number in it. The last of `order` must
    tell all rows apart."""
    dealt = df.repartitionByRange(n_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))
    return stage(dealt.select(*within, F.spark_partition_id().alias("part"), at.alias("at")), label)


def running_sums(groups: DataFrame) -> DataFrame:
    """text_hash, n (from 0) and upto (bytes of all groups up to this one) in order of the smallest doc_id."""
    order = [F.col("first").asc_nulls_first(), F.col("text_hash")]
    rows = numbered(groups, order, ["text_hash", "bytes"], "groups-in-order")
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("size"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    parts = parts.select(F.col("part").alias("of"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("rows", "size")))
    so_far = W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("own", F.sum("bytes").over(so_far)).join(F.broadcast(parts), F.col("part") == F.col("of"))
    return stage(rows.select("text_hash", (F.col("rows_before") + F.col("at")).alias("n"), (F.col("size_before") + F.col("own")).alias("upto")), "running-sums")


def smallest_capacity(sums: DataFrame, count: int, shards: int, summary: int = SUMMARY) -> tuple[int, Sums]:
    """The smallest capacity of `shards` contiguous runs over `count` groups, and the places known by then."""

    def read(rows: DataFrame, step: int) -> list[tuple[int, int]]:
        return [tuple(r) for r in rows.where((F.col("n") % step == step - 1) | (F.col("n") == count - 1)).select("n", "upto").collect()]

    found = read(sums, -(-count // summary))
    while True:
        known = Sums(found)
        low, high = known.capacity(shards, True), known.capacity(shards, False)
        if low == high:
            return high, known
        ranges = known.unclear(shards, low, high)
        inside = F.lit(False)
        for a, b in ranges:
            inside |= F.col("n").between(a, b)
        widest = max(known.gap(i) for i in range(len(known.sums)) if any(a <= known.numbers[i] <= b for a, b in ranges))
        # at least one new place within the widest gap, so that every read gets on
        found += read(sums.where(inside), max(1, min(-(-sum(b - a + 1 for a, b in ranges) // summary), widest // 2)))


def shard(docs: DataFrame, *, shards: int = 40, summary: int = SUMMARY) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of each row of docs (doc_id, text)."""
    if not 0 < shards <= MOST_SHARDS:
        raise ValueError(f"from 1 to {MOST_SHARDS} shards")
    text = whole_text(F.col("text"))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + EXTRA).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("row"),
    )
    rows = stage(rows, "sizes")
    groups = stage(rows.groupBy("text_hash").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("first")), "groups")
    count, left = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    own, free = [], shards
    for g in groups.orderBy(F.col("bytes").desc(), "text_hash").limit(shards).collect():
        if g["bytes"] * free <= left:
            break
        own.append((g["first"] is not None, g["first"], g["text_hash"]))
        left, free = left - g["bytes"], free - 1
    own = [h for *_, h in sorted(own)]

    cuts, placed = [], running_sums(groups.where(~F.col("text_hash").isin(own)))
    if count > len(own):
        capacity, known = smallest_capacity(placed, count - len(own), free, summary)
        cuts = known.cuts(free, capacity)
    at = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c < F.col("upto"))) if cuts else F.lit(0)
    alone = F.lit(None).cast("int")
    for i, h in enumerate(own):
        alone = F.when(F.col("text_hash") == F.lit(h), free + i).otherwise(alone)
    rows = rows.join(placed.select("text_hash", at.cast("int").alias("run")), "text_hash", "left").withColumn("shard", F.coalesce("run", alone))
    columns = ["doc_id", "size", "text_crc32", "shard"]
    rows = stage(rows.select(*columns, "text_hash", "row"), "sharded")

    order = [F.col("shard"), F.col("doc_id").asc_nulls_first(), F.col("text_hash"), F.col("row")]
    rows = numbered(rows, order, columns, "slots")
    # at most a row for each partition and one more for each shard
    parts = rows.groupBy("part", "shard").agg(F.min("at").alias("from"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select(F.col("part").alias("of"), F.col("shard").alias("in"), (F.coalesce(before, F.lit(0)) - F.col("from")).alias("shift"))
    rows = rows.join(F.broadcast(parts), (F.col("part") == F.col("of")) & (F.col("shard") == F.col("in")))
    return rows.select(*columns, (F.col("at") + F.col("shift")).alias("slot"))
