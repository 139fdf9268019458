"""Exact percentiles of any number of values: ranks are narrowed down by histograms, so no task holds a group's values.

A percentile lies between two ranks. The range of a group is cut into bins, counted, and only bins that hold a wanted rank
are kept and cut again, until few values are left or all of them are equal. Counts are combined before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubbub.sources.staging import staged

#: Bins that a range is cut into, and the number of values that may be ordered in one task.
FAN, FEW = 1 << 12, 1 << 16


def exact_percentiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float], fan: int = FAN, few: int = FEW) -> DataFrame:
    """by, n and a column for each percentile (name -> share), linear between ranks. NULL and NaN values do not count; a group
    without values is left out. NULL is a group like any other."""
    number = F.col(value).cast("double")
    keyed = df.where(number.isNotNull() & ~F.isnan(number)).select(F.to_json(F.struct(F.lit(1).alias("_"), *by)).alias("cell"), *by, number.alias("v"))
    rows = staged(keyed, "values")
    groups = staged(rows.groupBy("cell", *by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups")
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ends = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in wanted.values()))))
    cells = groups.select("cell", F.col("cell").alias("root"), "n", "lo", "hi", F.lit(0).cast("long").alias("base"), ends.alias("ranks"))
    rows, settled = rows.select("cell", "v"), None

    while True:
        equal = cells.where("lo = hi").select("root", F.explode("ranks").alias("rank"), F.col("lo").alias("v"))
        settled = equal if settled is None else settled.unionByName(equal)
        cells = cells.where("lo < hi")
        if cells.where(F.col("n") > few).isEmpty():
            break
        # quarters, so that no difference overflows
        share = (F.col("v") / 4 - F.col("lo") / 4) / (F.col("hi") / 4 - F.col("lo") / 4)
        binned = rows.join(cells, "cell").select("cell", "root", "base", "ranks", "v", F.least(F.floor(share * fan), F.lit(fan - 1)).alias("bin"))
        counts = binned.groupBy("cell", "root", "base", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("ranks").alias("ranks"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("cell").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("base", F.col("base") + before)
        inside = F.filter("ranks", lambda r: (r >= F.col("base")) & (r < F.col("base") + F.col("n")))
        found = counts.withColumn("ranks", inside).where(F.size("ranks") > 0)
        found = staged(found.select("cell", "bin", F.concat_ws(".", "cell", F.col("bin").cast("string")).alias("part"), "root", "n", "lo", "hi", "base", "ranks"), "cells")
        rows = staged(binned.select("cell", "bin", "v").join(found.where("lo < hi").select("cell", "bin", "part"), ["cell", "bin"]).select(F.col("part").alias("cell"), "v"), "values")
        cells = found.select(F.col("part").alias("cell"), "root", "n", "lo", "hi", "base", "ranks")

    each = rows.join(cells.select("cell", "root", "base", "ranks"), "cell").groupBy("cell", "root", "base", "v").agg(F.count(F.lit(1)).alias("n"), F.first("ranks").alias("ranks"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("cell").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("base", F.col("base") + before)
    hit = F.filter("ranks", lambda r: (r >= F.col("base")) & (r < F.col("base") + F.col("n")))
    settled = settled.unionByName(each.select("root", F.explode(hit).alias("rank"), "v"))
    # at most two ranks for each percentile
    held = settled.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    out = groups.join(held, groups["cell"] == held["root"])

    def between(p: float) -> Column:
        at = place(p)
        low, high = F.col("at")[F.floor(at)], F.col("at")[F.ceil(at)]
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))

    return out.select(*(groups[c] for c in by), "n", *(between(p).alias(name) for name, p in wanted.items()))
