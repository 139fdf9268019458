"""Posts about one matter: runs of posts that share an entity, merged where they share a post, a quote or a repost.

The unit is a cluster, not a post. Time is part of what makes one: an entity gives a run of posts only while no gap between
them is above a limit. Runs that share a post are one cluster, and so are a post and the post that it quotes or reposts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubbub.operators.components import connected_components
from hubbub.sources.staging import staged


def entity_runs(mentions: DataFrame, gap_hours: int) -> DataFrame:
    """entity, post_id, run: posts about an entity with no gap above gap_hours share a run, named by its first bucket.

    mentions: entity, post_id, published_at. Time is cut to buckets as long as the gap. Posts within a bucket are never
    further apart than that, so only the first and last post of each bucket are ordered, and a very common entity is
    ordered by its buckets, not by its posts. A NULL time or entity belongs to no run."""
    seconds = gap_hours * 3600
    at = F.unix_micros(F.col("published_at").cast("timestamp"))
    rows = mentions.where("entity is not null and published_at is not null")
    rows = rows.select("entity", "post_id", at.alias("at"), F.floor(at / (seconds * 1_000_000)).alias("bucket"))
    ends = rows.groupBy("entity", "bucket").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    order = W.partitionBy("entity").orderBy("bucket")
    gap = F.col("first") - F.lag("last").over(order)
    starts = F.when(F.coalesce(gap > seconds * 1_000_000, F.lit(True)), F.col("bucket"))
    runs = ends.select("entity", "bucket", F.last(starts, ignorenulls=True).over(order).alias("run"))
    return rows.join(runs.hint("merge"), ["entity", "bucket"]).select("entity", "post_id", "run")


def run_links(runs: DataFrame) -> DataFrame:
    """u, v: each post of a run and the run's smallest post, so a run of n posts costs n links, not n * n."""
    hubs = staged(runs.groupBy("entity", "run").agg(F.min("post_id").alias("v")), "run-hubs")
    return runs.join(hubs, ["entity", "run"]).select(F.col("post_id").alias("u"), "v").where("u <> v")


def post_clusters(posts: DataFrame, mentions: DataFrame, shares: DataFrame, gap_hours: int) -> DataFrame:
    """post_id, cluster_id (the cluster's smallest post) of every post; one that shares nothing is a cluster of its own.

    posts: post_id. mentions: entity, post_id, published_at. shares: post_id and the post_id `of` that it quotes or
    reposts; shares of posts that are not among posts link nothing. Joins by post are merges: ids are far larger
    in memory than in files, by whose size Spark would send all of them to every executor."""
    known = posts.select("post_id").distinct().hint("merge")
    shares = shares.join(known, "post_id", "left_semi").join(known.select(F.col("post_id").alias("of")).hint("merge"), "of", "left_semi")
    links = run_links(entity_runs(mentions.join(known, "post_id", "left_semi"), gap_hours)).unionByName(shares.select(F.col("post_id").alias("u"), F.col("of").alias("v")))
    labels = connected_components(links).withColumnsRenamed({"node": "post_id", "component": "label"})
    return known.join(labels.hint("merge"), "post_id", "left").select("post_id", F.coalesce("label", "post_id").alias("cluster_id"))


def describe_clusters(clusters: DataFrame, posts: DataFrame, mentions: DataFrame, min_share: float = 0.8) -> DataFrame:
    """cluster_id, posts, authors, entities, first_at, last_at, score = authors / posts and whether it is from many voices:
    a cluster that few accounts fill is told from its own posts, without any history of the accounts."""
    rows = clusters.join(posts.select("post_id", "author_id", "published_at").hint("merge"), "post_id")
    # distinct pairs first, so that no cluster holds its authors in one buffer
    authors = rows.select("cluster_id", "author_id").distinct().groupBy("cluster_id").agg(F.count("author_id").alias("authors"))
    named = clusters.join(mentions.select("post_id", "entity").hint("merge"), "post_id").select("cluster_id", "entity").distinct()
    entities = named.groupBy("cluster_id").agg(F.count("entity").alias("entities"))
    out = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("posts"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))
    share = F.col("authors") / F.col("posts")
    out = out.join(authors, "cluster_id").join(entities, "cluster_id", "left").withColumn("entities", F.coalesce("entities", F.lit(0)).cast("long"))
    return out.select("cluster_id", "posts", "authors", "entities", "first_at", "last_at", F.round(share, 6).alias("score"), (share >= min_share).alias("many_voices"))


def effective_counts(described: DataFrame, clusters: DataFrame, relevant: DataFrame) -> DataFrame:
    """topic, posts, clusters and clusters of many voices: how much smaller a topic's sample is once repeats are merged.
    relevant: post_id, topic."""
    rows = relevant.select("post_id", "topic").join(clusters, "post_id").groupBy("topic", "cluster_id").agg(F.count(F.lit(1)).alias("posts"))
    rows = rows.join(described.select("cluster_id", "many_voices"), "cluster_id")
    return rows.groupBy("topic").agg(F.sum("posts").alias("posts"), F.count(F.lit(1)).alias("clusters"), F.count_if("many_voices").alias("many_voices"))
