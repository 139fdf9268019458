"""Topics of two adjacent windows: [as_of - 2w, as_of - w) and [as_of - w, as_of)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def instant(as_of: str) -> Column:
    """A UTC time without zone; text that names another zone is rejected."""
    moment = dt.datetime.fromisoformat(as_of)
    if moment.tzinfo and moment.utcoffset():
        raise ValueError("as_of must be UTC")
    return F.lit(moment.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def window_bounds(spark, as_of: str, w: int) -> DataFrame:
    t = instant(as_of)
    return spark.range(1).select((t - days(2 * w)).alias("prev_start"), (t - days(w)).alias("prev_end"), (t - days(w)).alias("cur_start"), t.alias("cur_end"))


def in_window(time: Column, as_of: str, w: int, back: int = 0) -> Column:
    """back: how many windows before the current one."""
    t = instant(as_of)
    return (time >= t - days(w * (back + 1))) & (time < t - days(w * back))


def exclude_authors(posts: DataFrame, authors: DataFrame | None) -> DataFrame:
    """None and an empty table both exclude nobody."""
    return posts if authors is None else posts.join(authors.select("author_id"), "author_id", "left_anti")


def growth(cur, prev) -> Column:
    """NULL, not infinite, when there was nothing before."""
    return F.when(F.col(prev) > 0, (F.col(cur) - F.col(prev)) / F.col(prev))


def trend_compare(posts: DataFrame, as_of: str, w: int, excluded: DataFrame | None = None) -> DataFrame:
    """posts: topic, author_id, published_at. Reduced to (topic, author) first, so that the distinct counts cost no second pass."""
    now, then = in_window(F.col("published_at"), as_of, w), in_window(F.col("published_at"), as_of, w, 1)
    rows = exclude_authors(posts.where(now | then), excluded)
    by_author = rows.groupBy("topic", "author_id").agg(F.count_if(now).alias("c"), F.count_if(then).alias("p"))
    out = by_author.groupBy("topic").agg(
        F.sum("c").alias("n_cur"), F.sum("p").alias("n_prev"), F.count_if(F.col("c") > 0).alias("authors_cur"), F.count_if(F.col("p") > 0).alias("authors_prev")
    )
    everything = W.partitionBy()
    return out.select(
        "*", (F.col("n_cur") - F.col("n_prev")).alias("abs_delta"), F.round(growth("n_cur", "n_prev"), 6).alias("rel_growth"),
        F.round(F.try_divide("n_cur", F.sum("n_cur").over(everything)), 6).alias("share_cur"), F.round(F.try_divide("n_prev", F.sum("n_prev").over(everything)), 6).alias("share_prev"),
    )


def trend_rank(compared: DataFrame, min_posts: int = 5) -> DataFrame:
    """Numbered by delta, growth (unknown last) and topic, all descending."""
    rows = compared.where(F.col("n_cur") >= min_posts).withColumn("share_delta", F.round(F.col("share_cur") - F.col("share_prev"), 6))
    order = W.orderBy(F.desc("abs_delta"), F.desc_nulls_last("rel_growth"), F.desc("topic"))
    return rows.withColumn("rank", F.row_number().over(order))


def recent_topics(posts: DataFrame, as_of: str, w: int, k: int = 10) -> DataFrame:
    now, then = in_window(F.col("published_at"), as_of, w), in_window(F.col("published_at"), as_of, w, 1)
    rows = posts.where(now | then).groupBy("topic").agg(F.count_if(now).alias("n"), F.count_if(then).alias("n_before"), F.countDistinct(F.when(now, F.col("author_id"))).alias("authors"))
    rows = rows.where("n > 0").withColumn("delta", F.col("n") - F.col("n_before"))
    label = F.when(F.col("n_before") == 0, "newly").when(F.col("delta") > 0, "increasing").when(F.col("delta") < 0, "decreasing").otherwise("unchanged")
    place = F.row_number().over(W.orderBy(F.desc("n"), "topic"))
    return rows.withColumn("activity", label).withColumn("place", place).where(F.col("place") <= k).withColumn("most_discussed", F.col("place") == 1)


def rate_growth(posts: DataFrame, as_of: str, recent: int, base: int, eps: float = 0.1) -> DataFrame:
    t = instant(as_of)
    now = (F.col("published_at") >= t - days(recent)) & (F.col("published_at") < t)
    before = (F.col("published_at") >= t - days(recent + base)) & (F.col("published_at") < t - days(recent))
    rows = posts.groupBy("topic").agg((F.count_if(now) / recent).alias("r"), (F.count_if(before) / base).alias("b"))
    return rows.select("topic", F.round("r", 6).alias("recent_rate"), F.round("b", 6).alias("base_rate"), F.round((F.col("r") - F.col("b")) / F.greatest("b", F.lit(eps)), 6).alias("rate_growth"))
