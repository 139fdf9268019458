"""Registry events in posts by substring: matches, visibility and the funnel from event to discussion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubbub.operators.keyfilter import admitted, key_bits


def rarest_key(entities: DataFrame, keys: Column) -> DataFrame:
    """entities with `token`, of each row's keys the one that fewest rows have. A key that all share, such as a common
    last word, would bring every post that has it to every row."""
    rows = entities.withColumn("token", F.explode(F.array_distinct(keys)))
    common = rows.groupBy("token").agg(F.count(F.lit(1)).alias("rows"))
    rare = F.min_by("token", F.struct("rows", "token")).alias("token")
    return rows.join(common, "token").groupBy(*entities.columns).agg(rare)


def grams(text: Column, n: int) -> Column:
    """All runs of n characters; none of a shorter text."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))


def match_portal(posts: DataFrame, entities: DataFrame, before: int = 14, after: int = 30, n: int = 6) -> DataFrame:
    """event_id, post_id, matched_on: posts whose text holds an entity, in any case, within the days around its event. One row
    for each event and post, matched_on the first kind by name.

    entities: event_id, at, entity, kind; those shorter than n are left out. Posts and entities meet on the entity's rarest run of
    n characters, of which each post keeps those that a filter of all such runs admits before they are exploded; only ids travel
    there, the text is fetched for hits and then compared in full."""
    known = entities.where((F.length("entity") >= n) & F.col("at").isNotNull()).select("event_id", "at", F.lower("entity").alias("entity"), "kind").distinct()
    keyed = rarest_key(known, grams(F.col("entity"), n))
    low = F.lower("text")
    found = posts.select("post_id", "published_at", F.explode(admitted(F.array_distinct(grams(low, n)), key_bits(keyed))).alias("token")).join(keyed, "token")
    days = lambda k: F.make_dt_interval(F.lit(k))
    found = found.where((F.col("published_at") >= F.col("at") - days(before)) & (F.col("published_at") <= F.col("at") + days(after)))
    texts = posts.select("post_id", low.alias("low"))
    hits = found.select("event_id", "entity", "kind", "post_id").join(texts, "post_id").where(F.col("low").contains(F.col("entity")))
    return hits.groupBy("event_id", "post_id").agg(F.min("kind").alias("matched_on"))


def visibility(events: DataFrame, matches: DataFrame, posts: DataFrame, edges: DataFrame) -> DataFrame:
    """For each event its posts, authors, replies, quotes and distinct reposters, and whether there is a post at all."""
    about = matches.select("event_id", "post_id").distinct().join(posts.select("post_id", "author_id"), "post_id")
    own = about.groupBy("event_id").agg(F.count(F.lit(1)).alias("posts"), F.countDistinct("author_id").alias("actors"))
    kind = F.col("edge_type")
    made = about.join(edges.select(F.col("target_id").alias("post_id"), "edge_type", "actor"), "post_id").groupBy("event_id").agg(
        F.count_if(kind == "reply").alias("replies"), F.count_if(kind == "quote").alias("quotes"), F.countDistinct(F.when(kind == "repost", F.col("actor"))).alias("reposters")
    )
    rows = events.select("event_id").distinct().join(own, "event_id", "left").join(made, "event_id", "left").fillna(0)
    return rows.withColumn("visible", F.col("posts") > 0)


STEPS = ("events", "trace", "captured", "organic", "interaction", "discussion")


def funnel(events: DataFrame, matches: DataFrame, posts: DataFrame, seeds: DataFrame, broadcast: DataFrame, edges: DataFrame, validated: DataFrame) -> DataFrame:
    """step, name, events: how many events pass each step and all before it: any trace, a trace among the seeds, one by an
    account that is no broadcast, a reply or quote below it, a reply that was validated as discussion.

    seeds: post_id. broadcast: author_id. validated: edge_no."""
    flag = lambda d, c: d.select(c).distinct().withColumn("yes", F.lit(True))
    rows = matches.select("event_id", "post_id").distinct().join(posts.select("post_id", "author_id"), "post_id")
    rows = rows.join(flag(seeds, "post_id").withColumnRenamed("yes", "seed"), "post_id", "left").join(flag(broadcast, "author_id").withColumnRenamed("yes", "loud"), "author_id", "left")
    talk = edges.where("edge_type in ('reply', 'quote')").join(flag(validated, "edge_no"), "edge_no", "left")
    talk = talk.groupBy(F.col("target_id").alias("post_id")).agg(F.bool_or(F.coalesce("yes", F.lit(False))).alias("human"), F.lit(True).alias("talk"))
    rows = rows.join(talk, "post_id", "left")
    seed, organic = F.col("seed").isNotNull(), F.col("seed").isNotNull() & F.col("loud").isNull()
    reached = F.when(organic & F.coalesce("human", F.lit(False)), 6).when(organic & F.col("talk").isNotNull(), 5).when(organic, 4).when(seed, 3).otherwise(2)
    best = rows.groupBy("event_id").agg(F.max(reached).alias("reached"))
    each = events.select("event_id").distinct().join(best, "event_id", "left").withColumn("reached", F.coalesce("reached", F.lit(1)))
    step = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("name")) for i, name in enumerate(STEPS)))).alias("s")
    return each.select("reached", step).groupBy("s.step", "s.name").agg(F.count_if(F.col("reached") >= F.col("s.step")).alias("events"))
