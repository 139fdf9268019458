"""Short window jobs over daily topic counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubbub.operators.trend import days, instant


def _by_day():
    return W.partitionBy("topic").orderBy("day")


def filled_daily(posts: DataFrame) -> DataFrame:
    """topic, day, n with a 0 for every day without posts between the corpus's first and last."""
    daily = posts.groupBy("topic", F.to_date("published_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    span = daily.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    grid = daily.select("topic").distinct().crossJoin(F.broadcast(span)).select("topic", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return grid.join(daily, ["topic", "day"], "left").select("topic", "day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def moving_average(daily: DataFrame, k: int) -> DataFrame:
    return daily.withColumn("moving", F.round(F.avg("n").over(_by_day().rowsBetween(1 - k, 0)), 6))


def rolling_centered(daily: DataFrame, k: int) -> DataFrame:
    """NULL where the window is not whole."""
    half = _by_day().rowsBetween(-(k // 2), k // 2)
    return daily.select("topic", "day", F.when(F.count(F.lit(1)).over(half) == k, F.round(F.avg("n").over(half), 6)).alias("rolling"))


def acceleration(daily: DataFrame) -> DataFrame:
    return daily.select("topic", "day", (F.col("n") - 2 * F.lag("n").over(_by_day()) + F.lag("n", 2).over(_by_day())).alias("acceleration"))


def volatility(daily: DataFrame) -> DataFrame:
    return daily.groupBy("topic").agg(F.round(F.try_divide(F.stddev_samp("n"), F.avg("n")), 6).alias("volatility"))


def zscore(daily: DataFrame, history: int) -> DataFrame:
    """Against the days before; not for sparse topics, whose spread says little."""
    past = _by_day().rowsBetween(-history, -1)
    mean, sd, n = F.avg("n").over(past), F.stddev_samp("n").over(past), F.count("n").over(past)
    return daily.select("topic", "day", F.when((n == history) & (sd > 0), F.round((F.col("n") - mean) / sd, 6)).alias("z"))


def novelty(posts: DataFrame, as_of: str, w: int) -> DataFrame:
    return posts.groupBy("topic").agg(F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"), F.bool_or(F.col("published_at") < instant(as_of) - days(w)).alias("in_baseline"))


def persistence(daily: DataFrame, least: int) -> DataFrame:
    """The longest run of days with `least` posts: day minus row number is the same within a run."""
    rows = daily.where(F.col("n") >= least).withColumn("island", F.date_sub("day", F.row_number().over(_by_day())))
    return rows.groupBy("topic", "island").agg(F.count(F.lit(1)).alias("run")).groupBy("topic").agg(F.max("run").alias("longest"))


def recurrence(posts: DataFrame, gap: int) -> DataFrame:
    """How often an author comes back after `gap` silent days or more."""
    rows = posts.select("author_id", F.to_date("published_at").alias("day")).distinct()
    silent = F.date_diff("day", F.lag("day").over(W.partitionBy("author_id").orderBy("day"))) - 1
    return rows.withColumn("gap", silent).groupBy("author_id").agg(F.count_if(F.col("gap") >= gap).alias("returns"), F.max("gap").alias("longest_gap"))


def engagement_median(posts: DataFrame) -> DataFrame:
    e = F.col("like_count") + F.col("repost_count")
    return posts.groupBy("topic").agg(F.sum(e).alias("total"), F.percentile(e, 0.5).alias("median"))


def candidate_rule(compared: DataFrame, min_posts: int, min_growth: float, min_authors: int) -> DataFrame:
    tests = {"volume": F.col("n_cur") >= min_posts, "growth": F.coalesce(F.col("rel_growth") > min_growth, F.lit(True)), "authors": F.col("authors_cur") >= min_authors}
    reasons = F.array_compact(F.array(*(F.when(c, name) for name, c in tests.items())))
    every = tests["volume"] & tests["growth"] & tests["authors"]
    return compared.select("topic", "n_cur", "rel_growth", "authors_cur", every.alias("emerging"), F.array_join(reasons, ",").alias("reasons"))


def informative_users(posts: DataFrame, topic: str = "error") -> DataFrame:
    """Mean daily share of event posts, weighted by the logarithm of the most followers that an author's posts tell of."""
    daily = posts.groupBy("author_id", F.to_date("published_at").alias("day")).agg(
        F.count(F.lit(1)).alias("posts"), F.count_if(F.col("topic") == topic).alias("event_posts"), F.max("followers").alias("followers")
    )
    rows = daily.groupBy("author_id").agg(F.avg(F.col("event_posts") / F.col("posts")).alias("m"), F.max("followers").alias("followers"))
    return rows.select("author_id", F.round("m", 6).alias("mean_share"), F.round(F.col("m") * F.ln(F.col("followers") + 1), 6).alias("score"))
