"""Accounts: activity, broadcast-like ones, audience and type, what they make up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubbub.operators.numbering import numbered

#: Hours after which a post's counts are taken as settled.
SETTLED = 24


def settled(hours: int = SETTLED) -> Column:
    return F.col("collected_at") - F.col("published_at") >= F.make_dt_interval(F.lit(0), F.lit(hours))


def engagement() -> Column:
    """NULL if either count is, so that such posts leave averages."""
    return F.col("like_count") + F.col("repost_count")


def author_activity(posts: DataFrame) -> DataFrame:
    zero = settled() & (engagement() == 0)
    rows = posts.groupBy("author_id").agg(
        F.count(F.lit(1)).alias("n_posts"), F.countDistinct(F.to_date("published_at")).alias("n_days"), F.round(F.avg(engagement()), 6).alias("avg_engagement"),
        F.count_if(settled() & engagement().isNotNull()).alias("n_settled"), F.count_if(zero).alias("n_settled_zero"),
    )
    return rows.withColumn("zero_rate", F.round(F.try_divide("n_settled_zero", "n_settled"), 6))


def is_broadcast(min_posts: int = 5, min_days: int = 4, min_zero: float = 0.6) -> Column:
    """Unknown zero rates are no broadcast."""
    return (F.col("n_posts") >= min_posts) & (F.col("n_days") >= min_days) & F.coalesce(F.col("zero_rate") >= min_zero, F.lit(False))


def broadcast_authors(activity: DataFrame, **limits) -> DataFrame:
    """With their places, most posts first, ties by author."""
    rows = activity.where(is_broadcast(**limits)).select("author_id", "n_posts", "n_days", "zero_rate")
    return numbered(rows, [F.desc("n_posts"), F.col("author_id")])


def broadcast_share(activity: DataFrame) -> DataFrame:
    rows = activity.agg(
        F.sum(F.when(is_broadcast(), F.col("n_posts")).otherwise(0)).alias("posts"), F.sum("n_posts").alias("all_posts"), F.count_if(is_broadcast()).alias("authors"), F.count(F.lit(1)).alias("all_authors")
    )
    share = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), 6), F.lit(0.0))
    return rows.select("*", share("posts", "all_posts").alias("post_share"), share("authors", "all_authors").alias("author_share"))


def flag_broadcast(posts: DataFrame, activity: DataFrame) -> DataFrame:
    """posts with broadcast, never null."""
    found = activity.where(is_broadcast()).select("author_id", F.lit(True).alias("broadcast"))
    return posts.join(found, "author_id", "left").withColumn("broadcast", F.coalesce("broadcast", F.lit(False)))


def broadcast_gap(flagged: DataFrame, hours: int = 0) -> DataFrame:
    """hours: only posts that were collected more than so long after they were published."""
    rows = flagged.where(F.col("collected_at") - F.col("published_at") > F.make_dt_interval(F.lit(0), F.lit(hours))) if hours else flagged
    return rows.groupBy("broadcast").agg(F.count(F.lit(1)).alias("posts"), F.round(F.avg(engagement()), 6).alias("mean_engagement"), F.round(F.avg((engagement() == 0).cast("int")), 6).alias("zero_rate"))


def actor_composition(flagged: DataFrame) -> DataFrame:
    """Per topic: how much comes from broadcast accounts and how to read it."""
    rows = flagged.groupBy("topic").agg(
        F.count(F.lit(1)).alias("posts"), F.count_if("broadcast").alias("broadcast_posts"), F.countDistinct("author_id").alias("authors"), F.countDistinct(F.when(F.col("broadcast"), F.col("author_id"))).alias("broadcast_authors")
    )
    share = F.col("broadcast_posts") / F.col("posts")
    reading = F.when(share >= 0.5, "mostly broadcast").when(share >= 0.2, "mixed").otherwise("mostly organic")
    return rows.select("*", F.bround(share, 4).alias("share"), reading.alias("reading"))


def measure_audience(posts: DataFrame) -> DataFrame:
    """engaged from a settled mean of 1 on, unheard below it, unknown if nothing is settled."""
    mean = F.avg(F.when(settled(), engagement()))
    rows = posts.groupBy("author_id").agg(F.count(F.lit(1)).alias("n_posts"), F.count_if(settled() & engagement().isNotNull()).alias("n_settled"), F.round(mean, 6).alias("mean_engagement"))
    audience = F.when(F.col("n_settled") == 0, "unknown").when(F.col("mean_engagement") >= 1, "engaged").otherwise("unheard")
    return rows.withColumn("audience", audience)


def profile_tier(n_posts: Column) -> Column:
    return F.when(n_posts >= 5, "established").when(n_posts >= 3, "provisional").otherwise("single")


# The type of each function with an audience and without one.
TYPES = {
    "incident_feed": ("intel_feed_amplified", "intel_feed_raw"),
    "promotion": ("promotion_reaching", "promotion_unheard"),
    "news_media": ("news_with_reach", "news_syndicated"),
    "individual": ("organic_attention", "individual_unheard"),
    "org_other": ("org_reaching", "org_unheard"),
}
PATTERNS = ("incident_feed", "promotion")


def derive_actor_type(function: Column, audience: Column, n_posts: Column, floor: int = 3) -> Column:
    """unclassified if either side is unknown, or if a feed or promotion has fewer than `floor` posts to show its pattern."""
    unknown = ~F.coalesce(function.isin(*TYPES), F.lit(False)) | (F.coalesce(audience, F.lit("unknown")) == "unknown")
    out = F.when(unknown | function.isin(*PATTERNS) & (n_posts < floor), "unclassified")
    for name, (engaged, unheard) in TYPES.items():
        out = out.when((function == name) & (audience == "engaged"), engaged).when(function == name, unheard)
    return out


def build_profiles(audience: DataFrame, functions: DataFrame, version: str) -> DataFrame:
    rows = audience.join(functions, "author_id", "left")
    confidence = F.when(F.col("n_posts") >= 5, 0.9).when(F.col("n_posts") >= 3, 0.6).otherwise(0.3)
    kind = derive_actor_type(F.col("function"), F.col("audience"), F.col("n_posts"))
    return rows.select("author_id", "n_posts", "audience", "function", kind.alias("actor_type"), profile_tier(F.col("n_posts")).alias("tier"), confidence.alias("confidence"), F.lit(version).alias("profile_version"))


_FEEDS, _PROMOTION, _ORGS = TYPES["incident_feed"], TYPES["promotion"], TYPES["org_other"]
#: What each question leaves out: attention is neither feeds nor promotion, events come from feeds too.
DROPPED = {"attention": (*_FEEDS, *_PROMOTION), "events": _PROMOTION, "all": ()}
#: The one question that keeps only listed types.
KEPT = {"ecosystem": (*_PROMOTION, *_ORGS)}


def mode_exclusion(profiles: DataFrame, mode: str) -> DataFrame:
    """Authors to leave out. unclassified stays in attention, events and all; ecosystem keeps only its listed types."""
    if mode not in DROPPED and mode not in KEPT:
        raise ValueError(f"unknown mode {mode!r}; one of {sorted((*DROPPED, *KEPT))}")
    kind = F.coalesce("actor_type", F.lit("unclassified"))
    out = ~kind.isin(*KEPT[mode]) if mode in KEPT else kind.isin(*DROPPED[mode])
    return profiles.where(out).select("author_id", "actor_type")


def profile_coverage(profiles: DataFrame) -> DataFrame:
    classified = F.sum(F.when(F.col("actor_type") != "unclassified", F.col("n_posts")).otherwise(0))
    return profiles.groupBy("tier").agg(F.sum("n_posts").alias("posts"), F.count(F.lit(1)).alias("authors"), F.round(classified / F.sum("n_posts"), 6).alias("classified_share"))


def author_strata(posts: DataFrame, min_posts: int = 50, below: float = 0.5) -> DataFrame:
    """Over the whole corpus; a missing count is 0 here."""
    mean = F.avg(F.coalesce("like_count", F.lit(0)) + F.coalesce("repost_count", F.lit(0)))
    rows = posts.groupBy("author_id").agg(F.count(F.lit(1)).alias("n"), F.round(mean, 6).alias("mean_engagement"))
    return rows.withColumn("stratum", F.when((F.col("n") >= min_posts) & (F.col("mean_engagement") < below), "feed").otherwise("other"))


def author_text_sample(posts: DataFrame, n: int = 8, cut: int = 280) -> DataFrame:
    """The longest texts of each author. Per (author, day) first, so that no author's rows all meet in one sort."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = posts.select("author_id", "post_id", F.to_date("published_at").alias("day"), F.substring(text, 1, cut).alias("sample"), F.length(text).alias("size"))
    order = (F.desc("size"), F.col("post_id"))
    for keys in (("author_id", "day"), ("author_id",)):
        rows = rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)
    return rows.select("author_id", "post_id", "place", "sample")
