"""Words, phrases and vectors compared between two periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubbub.operators.trend import in_window


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, links left out."""
    bare = F.regexp_replace(F.lower(text), r"https?://[^\s]+", " ")
    return F.regexp_extract_all(bare, F.lit("([a-z0-9]+)"), F.lit(1))


def ngrams(tokens: str, n: int) -> Column:
    last = F.size(tokens) - n
    grams = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))


def phrase_trend(posts: DataFrame, as_of: str, w: int, n: int = 2, min_posts: int = 3) -> DataFrame:
    """Posts with each phrase in the window and the one before it, and how much its share has grown (smoothed by one post).
    A phrase counts once a post; counts are combined before the shuffle."""
    now, before = in_window(F.col("published_at"), as_of, w), in_window(F.col("published_at"), as_of, w, 1)
    rows = posts.where(now | before).select(now.alias("now"), words(F.col("text")).alias("tokens"))
    totals = rows.agg(F.count_if("now").alias("n_now"), F.count_if(~F.col("now")).alias("n_before"))
    rows = rows.select("now", F.explode(F.array_distinct(ngrams("tokens", n))).alias("phrase")).groupBy("phrase").agg(F.count_if("now").alias("cur"), F.count_if(~F.col("now")).alias("prev"))
    rows = rows.where(F.col("cur") >= min_posts).crossJoin(F.broadcast(totals))  # one row of totals
    return rows.select("phrase", "cur", "prev", F.round((F.col("cur") + 1) / (F.col("n_now") + 1) / ((F.col("prev") + 1) / (F.col("n_before") + 1)), 6).alias("lift"))


def cooccurrence_shift(posts: DataFrame, targets: list[str], as_of: str, w: int, k: int = 10) -> DataFrame:
    """The k words met most often in posts with each given word, in the window and the one before it; ties by word.
    Only the given words are paired with the other words of their posts, so nothing grows with the square of a post."""
    now, before = in_window(F.col("published_at"), as_of, w), in_window(F.col("published_at"), as_of, w, 1)
    rows = posts.where(now | before).select(F.when(now, "cur").otherwise("prev").alias("period"), F.array_distinct(words(F.col("text"))).alias("tokens"))
    rows = rows.select("period", "tokens", F.explode(F.array_intersect("tokens", F.array(*map(F.lit, targets)))).alias("target"))
    rows = rows.select("period", "target", F.explode("tokens").alias("word")).where("word <> target").groupBy("period", "target", "word").agg(F.count(F.lit(1)).alias("posts"))
    place = F.row_number().over(W.partitionBy("period", "target").orderBy(F.desc("posts"), "word"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def centroid_shift(vectors: DataFrame, group: str, period: Column) -> DataFrame:
    """Cosine distance of a group's mean vectors in two periods (a boolean). Sums are combined by dimension, before the
    shuffle; groups without both periods get NULL. Rows with a null component are left out."""
    rows = vectors.where("embedding is not null and not exists(embedding, x -> x is null)").select(group, period.alias("later"), F.posexplode("embedding").alias("i", "x"))
    rows = rows.groupBy(group, "i").agg(F.avg(F.when(F.col("later"), F.col("x").cast("double"))).alias("a"), F.avg(F.when(~F.col("later"), F.col("x").cast("double"))).alias("b"))
    dot, norm = F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b")))
    return rows.groupBy(group).agg(F.round(1 - F.try_divide(dot, norm), 6).alias("shift"))


def entity_sessions(mentions: DataFrame, gap_hours: int, min_share: float = 0.8) -> DataFrame:
    """mentions: entity, post_id, author_id, published_at. Runs of posts about an entity with no gap above gap_hours, and
    whether as good as every post has its own author. Days are summed up first, so that a very common entity is
    ordered by its days only; a run so breaks between days whose last and first posts lie too far apart."""
    day = F.to_date("published_at").alias("day")
    days = mentions.groupBy("entity", day).agg(F.min("published_at").alias("a"), F.max("published_at").alias("b"))
    order = W.partitionBy("entity").orderBy("day")
    far = F.col("a") > F.lag("b").over(order) + F.expr(f"INTERVAL '{gap_hours}' HOUR")
    days = days.withColumn("run", F.sum(F.coalesce(far, F.lit(False)).cast("int")).over(order)).select("entity", "day", "run")
    rows = mentions.withColumn("day", day).join(days, ["entity", "day"]).groupBy("entity", "run").agg(
        F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), F.count(F.lit(1)).alias("posts"), F.countDistinct("author_id").alias("authors")
    )
    return rows.withColumn("score", F.round(F.col("authors") / F.col("posts"), 6)).withColumn("many_voices", F.col("authors") / F.col("posts") >= min_share)
