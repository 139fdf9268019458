"""Places in a global order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubbub.sources.staging import staged

_ROW = (1 << 33) - 1


def numbered(df: DataFrame, order: list[Column], into: str = "place") -> DataFrame:
    """df with each row's place in the order, from 1. Rows are dealt by range and sorted within; a place is the row's number in
    its range after the rows of the ranges before, of which there is one count for each. The order should tell rows apart,
    else equal ones get their places as they come."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))
    rows = staged(dealt.select("*", F.spark_partition_id().alias("part_"), at.alias("at_")), "ranges")
    before = F.coalesce(F.sum("rows_").over(W.orderBy("of_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = rows.groupBy(F.col("part_").alias("of_")).agg(F.count(F.lit(1)).alias("rows_")).select("of_", before.alias("before_"))  # a row for each range
    rows = rows.join(F.broadcast(ahead), F.col("part_") == F.col("of_"))
    return rows.withColumn(into, F.col("before_") + F.col("at_") + 1).drop("part_", "at_", "of_", "before_")
