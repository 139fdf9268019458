"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words: its weight's share of the whole, at most max_copies times its size,
the excess shared again by weight until no target is above. With r = target / size, every document of a source
gets floor(r) certain copies. The words left are drawn with unequal inclusion probabilities: p = min(1, c k), k the
number of binary digits of a document's size, so a page of a thousand words is taken more readily than a line of three,
and c such that the expected words are the words left. Documents are ranked by their random odds over their inclusion
odds, q = (u / (1 - u)) / (p / (1 - p)); those with p = 1 come first. They are taken in that order until the words left
are filled. The rank is held as qo / (1 + qo), o the odds of the source's mean p: the same order in [0, 1], spread evenly
also where all p are near 0 or 1.

The rank where a source is full is found from word counts for 4,096 bins of the rank and then for 4,096 parts of
the bin in which it fills up, so no source, however large, is ordered in one task: only that part is. c comes from
one row for each source and k.

Built-in functions only. u is a hash of seed and doc_id, so reruns agree. A null text has no words, a null
source is a source and comes last. Rows with equal doc_id share u and are ordered by rank, then by size; equal rows
among them are taken one by one. Sources of size 0 get nothing. An empty table gives no rows. Of other columns none is
read, so their names cannot clash. Up to FEW_SOURCES sources are broadcast, more are joined by a shuffle; results are
the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubbub.llm.common import stage, unbroken_words, whole_text

BINS = 1 << 12
#: Sources up to this number are broadcast; more are joined by a shuffle.
FEW_SOURCES = 50_000


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1): 52 bits of an md5, as the SQL twin computes it."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...], share: float, max_copies: float) -> DataFrame:
    """source, source_size, target from one row for each source."""
    everything = W.partitionBy()  # one row for each source
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("most", max_copies * F.col("source_size"))
    rows = rows.withColumn("goal", share * F.sum("source_size").over(everything))
    # filled in order of cap over weight: below the level at which the goal is met, a source stops at its cap
    rows = rows.withColumn("nth", F.row_number().over(W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())))
    below, above = W.orderBy("nth").rowsBetween(W.unboundedPreceding, -1), W.orderBy("nth").rowsBetween(W.currentRow, W.unboundedFollowing)
    capped = F.coalesce(F.sum("most").over(below), F.lit(0.0))
    rows = rows.withColumn("level", (F.col("goal") - capped) / F.sum("weight").over(above))
    full = F.col("most") <= F.col("level") * F.col("weight")
    level = F.min(F.when(~full, F.struct("nth", "level"))).over(everything)["level"]
    target = F.when(full, F.col("most")).otherwise(F.coalesce(level, F.col("level")) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def inclusion_slopes(classes: DataFrame, targets: DataFrame) -> DataFrame:
    """of (the source), slope: the c of p = min(1, c k) from the words of each (source, k)."""
    source = F.col("source").eqNullSafe(F.col("of"))
    rows = classes.join(targets.select(F.col("source").alias("of"), "left"), source).drop("of")
    from_top = W.partitionBy("source").orderBy(F.col("k").desc())
    above = F.coalesce(F.sum("words").over(from_top.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # as if all classes above were certain and this one not
    below = F.sum(F.col("words") * F.col("k")).over(from_top.rowsBetween(W.currentRow, W.unboundedFollowing))
    rows = rows.withColumn("slope", F.when(below > 0, (F.col("left") - above.cast("double")) / below.cast("double")).otherwise(0.0))
    open_ = F.struct(F.col("k"), F.col("slope"))
    top = rows.where(F.col("slope") * F.col("k") < 1).groupBy("source").agg(F.max(open_).alias("top"))
    return top.select(F.col("source").alias("of"), F.col("top.slope").alias("slope"))


def _edge(parts: DataFrame, plan: DataFrame, at: str) -> DataFrame:
    """of (the source), the part `at` in which its words left run out, and the words before that."""
    so_far = W.partitionBy("source").orderBy(at)
    rows = parts.withColumn("after", F.col("base") + F.sum("words").over(so_far)).withColumn("before", F.col("after") - F.col("words"))
    rows = rows.join(plan.select(F.col("source").alias("of"), "left"), F.col("source").eqNullSafe(F.col("of"))).where("left > 0 and after > left")
    edge = rows.groupBy("source").agg(F.min(F.struct(at, "before")).alias("edge"))
    return edge.select(F.col("source").alias("of"), F.col(f"edge.{at}").alias(f"edge_{at}"), F.col("edge.before").alias(f"{at}_before"))


def mix(
    docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_copies: int = 2, seed: int = 7, with_hash: bool = False
) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of each row of docs (doc_id, text, source); with_hash adds
    text_hash, the xxhash64 of the text, which tells rows of one doc_id apart."""
    known = F.col("source").eqNullSafe(F.col("of"))
    extra = [F.xxhash64(whole_text(F.col("text"))).alias("text_hash")] if with_hash else []
    rows = docs.select("doc_id", "source", unbroken_words(F.col("text")).alias("size"), *extra)
    rows = rows.withColumn("u", uniform(F.col("doc_id"), seed)).withColumn("k", F.length(F.bin("size")))
    rows = stage(rows, "sizes")

    classes = stage(rows.groupBy("source", "k").agg(F.sum("size").alias("words")), "classes")
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights=weights, share=share, max_copies=max_copies)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("certain", F.floor(ratio)).withColumn("left", F.col("target") - F.floor(ratio) * F.col("source_size"))
    targets = stage(targets, "targets")
    small = F.broadcast if targets.count() <= FEW_SOURCES else (lambda df: df)
    plan = stage(targets.join(inclusion_slopes(classes, targets), known, "left").drop("of").fillna(0.0, ["slope"]), "plan")

    u, p = F.col("u"), F.least(F.lit(1.0), F.col("slope") * F.col("k"))
    mean = F.col("left") / F.col("source_size")
    rank = (u * (1 - p) * mean) / (u * (1 - p) * mean + p * (1 - u) * (1 - mean))
    rank = F.when(F.col("left") > 0, rank).otherwise(u)
    part = F.least(F.floor(F.col("rank") * (BINS * BINS)), F.lit(BINS * BINS - 1)).cast("int")
    ranked = rows.join(small(plan.withColumnRenamed("source", "of")), known).drop("of").withColumn("rank", rank)
    ranked = ranked.withColumn("part", part).withColumn("bin", F.shiftright("part", 12))

    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words")).withColumn("base", F.lit(0).cast("long"))
    edge = stage(_edge(bins, plan, "bin"), "edge-bins")
    inside = ranked.join(small(edge), known & (F.col("bin") == F.col("edge_bin"))).drop("of")
    parts = inside.groupBy("source", "part", F.col("bin_before").alias("base")).agg(F.sum("size").alias("words"))
    edge = stage(_edge(parts, plan, "part"), "edge-parts")

    ranked = ranked.join(small(edge), known, "left").drop("of")
    in_edge = F.col("part") == F.col("edge_part")
    # one more copy for all before the edge; in it, in order of rank, for those that bring the sum nearer
    sure = F.when(F.col("left") <= 0, 0).when(F.col("edge_part").isNull() | (F.col("part") < F.col("edge_part")), 1).otherwise(0)
    usual = ranked.where(F.coalesce(~in_edge, F.lit(True))).withColumn("more", sure)
    order = W.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("part_before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    last = ranked.where(in_edge).withColumn("more", F.when(before + F.col("size") / 2 <= F.col("left"), 1).otherwise(0))
    both = usual.unionByName(last)
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("certain") + F.col("more")).cast("int").alias("copies"), *(["text_hash"] if with_hash else []))
