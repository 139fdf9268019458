"""Permutation tests for topic deltas.

An author's posts move together by a whole number of days, modulo both windows, so only counts for each (topic,
author, day) matter. The shift is a hash of iteration and author: results do not depend on partitions. A task turns each
author's counts into one sum for each topic and shift, adds those up for all draws, and sends a row for each draw and
topic, however many authors it has.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubbub.operators.trend import days, in_window, instant


def cells(posts: DataFrame, as_of: str, w: int) -> DataFrame:
    """topic, author_id, day (0 .. 2w-1), n. The post at as_of - w is on day w: current."""
    time = F.col("published_at")
    start = (instant(as_of) - days(2 * w)).cast("timestamp").cast("long")
    day = F.floor((time.cast("timestamp").cast("long") - start) / 86400)
    rows = posts.where(in_window(time, as_of, w) | in_window(time, as_of, w, 1))
    return rows.groupBy("topic", "author_id", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def observed(posts: DataFrame, as_of: str, w: int) -> DataFrame:
    side = F.when(F.col("day") >= w, F.col("n")).otherwise(-F.col("n"))
    return cells(posts, as_of, w).groupBy("topic").agg(F.sum(side).alias("delta"))


def author_shift(posts: DataFrame, as_of: str, w: int, iterations: int) -> DataFrame:
    """iteration, topic, delta. Each task sums its own authors; only (iteration, topic) sums are shuffled."""
    return shift_sums(cells(posts, as_of, w), w, iterations, (1,)).drop("scale")


#: Shifts are a polynomial of the author's hash modulo this prime, its coefficients a hash of the iteration.
PRIME = (1 << 31) - 1


def _words(text: str) -> list[int]:
    digest = hashlib.md5(text.encode()).hexdigest()
    return [int(digest[i : i + 8], 16) % PRIME for i in range(0, 32, 8)]


def shifts(author: str, copy: int, coefficients: np.ndarray, total: int) -> np.ndarray:
    """The days that a copy of an author moves in each draw. A polynomial of degree three makes any four authors
    independent. coefficients: a row of four for each draw."""
    h = _words(f"{author}#{copy}")[0]
    out = coefficients[:, 0]
    for k in range(1, 4):
        out = (out * h + coefficients[:, k]) % PRIME
    return out % total


def coefficients(iterations: int) -> np.ndarray:
    return np.array([_words(f"iteration:{i}") for i in range(iterations)], np.int64).reshape(-1, 4)


def shift_sums(rows: DataFrame, w: int, iterations: int, scales: tuple[int, ...]) -> DataFrame:
    """scale, iteration, topic, delta for scales times the pool of authors, all scales in one pass: a scale adds to the one
    before it the copies that it has more. rows: topic, author_id, day, n. A NULL author is one author."""
    total = 2 * w
    # sign[d, s]: a post of day d that moves by s days counts for the window or against it
    sign = np.where((np.arange(total)[:, None] + np.arange(total)[None]) % total >= w, 1, -1)
    ends = sorted(scales)

    def add(batches):
        draws, topics, sums = coefficients(iterations), {}, {}

        def author_ends(author, held):
            names = sorted({t for t, _, _ in held})
            counts = np.zeros((len(names), total), np.int64)
            for topic, day, n in held:
                counts[names.index(topic), day] += n
            by_shift, run = counts @ sign, np.zeros((len(names), iterations), np.int64)
            for copy in range(1, ends[-1] + 1):
                run += by_shift[:, shifts(author, copy, draws, total)]
                if copy in ends:
                    for i, topic in enumerate(names):
                        key = copy, topics.setdefault(topic, topic)
                        sums[key] = sums[key] + run[i] if key in sums else run[i].copy()

        author, held = None, []
        for batch in batches:
            for a, topic, day, n in zip(*(batch[c].to_pylist() for c in ("author_id", "topic", "day", "n"))):
                if held and a != author:
                    author_ends(author, held)
                    held = []
                author = a
                held.append((topic, day, n))
        if held:
            author_ends(author, held)
        for (scale, topic), delta in sums.items():
            columns = [pa.array(np.full(iterations, scale, np.int32)), pa.array(np.arange(iterations)), pa.array([topic] * iterations, pa.string()), pa.array(delta)]
            yield pa.RecordBatch.from_arrays(columns, ["scale", "iteration", "topic", "delta"])

    known = rows.select(F.coalesce("author_id", F.lit("")).alias("author_id"), F.col("topic").cast("string").alias("topic"), F.col("day").cast("long").alias("day"), "n")
    # the number of partitions is given: the few cells would be merged into one task, which makes all draws
    dealt = known.repartition(_tasks(rows), "author_id").sortWithinPartitions("author_id")
    return dealt.mapInArrow(add, "scale int, iteration long, topic string, delta long").groupBy("scale", "iteration", "topic").agg(F.sum("delta").alias("delta"))


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def post_permutation(posts: DataFrame, as_of: str, w: int, iterations: int, seed: int = 1) -> DataFrame:
    """Windows dealt anew among posts: current counts given topic totals are multivariate hypergeometric."""

    def draw(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                totals, n_cur = [x["n"] for x in row["topics"]], row["n_cur"]
                rng = np.random.default_rng((seed, row["iteration"]))
                cur = rng.multivariate_hypergeometric(totals, n_cur, method="marginals")
                out += [(row["iteration"], x["topic"], int(2 * c - x["n"])) for x, c in zip(row["topics"], cur)]
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["iteration", "topic", "delta"])

    topics = cells(posts, as_of, w).groupBy("topic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("day") >= w, F.col("n")).otherwise(0)).alias("c"))
    totals = topics.agg(F.sort_array(F.collect_list(F.struct("topic", "n"))).alias("topics"), F.sum("c").alias("n_cur")).where("n_cur is not null")
    rows = posts.sparkSession.range(0, iterations, 1, _tasks(posts)).withColumnRenamed("id", "iteration").crossJoin(F.broadcast(totals))
    return rows.select("iteration", "topics", "n_cur").mapInArrow(draw, "iteration long, topic string, delta long")


def summary(seen: DataFrame, drawn: DataFrame) -> DataFrame:
    """p = (b + 1) / (m + 1), never 0; p_fwer against the largest delta of each iteration, so never below p_raw."""
    most = drawn.groupBy("iteration").agg(F.max(F.abs("delta")).alias("most"))
    rows = drawn.join(F.broadcast(seen.withColumnRenamed("delta", "observed")), "topic").join(most, "iteration")
    p = lambda hit: F.round((F.count_if(hit) + 1) / (F.count(F.lit(1)) + 1), 6)
    size = F.abs("observed")
    out = rows.groupBy("topic", "observed").agg(
        F.round(F.avg("delta"), 6).alias("null_mean"), F.round(F.stddev_samp("delta"), 6).alias("null_sd"), F.round(F.percentile(F.abs("delta"), 0.95), 6).alias("null_p95"),
        p(F.abs("delta") >= size).alias("p_raw"), p(F.col("most") >= size).alias("p_fwer"),
    )
    top = most.agg(F.round(F.percentile("most", 0.95), 6).alias("max_null_p95"))
    verdict = F.when(F.col("p_fwer") <= 0.05, "signal").when(F.col("p_raw") <= 0.05, "weak").otherwise("noise")
    return out.crossJoin(F.broadcast(top)).withColumn("verdict", verdict)


def power_scale(posts: DataFrame, as_of: str, w: int, iterations: int, scales: tuple[int, ...]) -> DataFrame:
    """scale, topic, observed, max_null_p95, above: how a delta that grows with the pool of authors compares with the largest
    delta of each draw, for copies of that pool."""
    own = cells(posts, as_of, w)
    side = F.when(F.col("day") >= w, F.col("n")).otherwise(-F.col("n"))
    seen = own.groupBy("topic").agg(F.sum(side).alias("delta"))
    most = shift_sums(own, w, iterations, scales).groupBy("scale", "iteration").agg(F.max(F.abs("delta")).alias("most"))
    limit = most.groupBy("scale").agg(F.round(F.percentile("most", 0.95), 6).alias("max_null_p95"))
    rows = seen.join(F.broadcast(limit)).withColumn("observed", F.col("scale") * F.col("delta"))  # a row for each scale
    return rows.select("scale", "topic", "observed", "max_null_p95", (F.abs("observed") > F.col("max_null_p95")).alias("above"))
