"""Page and thread bodies, written from posts and conversations and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubbub.plans.catalog import register
from hubbub.sources import payloads as s


def pages(t):
    author = F.struct(F.col("author_id").alias("did"), F.col("author_handle").alias("handle"))
    reply = F.when(F.col("in_reply_to").isNotNull(), F.struct(F.struct(F.col("in_reply_to").alias("uri")).alias("parent")))
    stamp = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    record = F.struct(F.when(F.col("post_id") % 7 > 0, stamp).alias("createdAt"), "text", F.when(F.col("lang").isNotNull(), F.array("lang")).alias("langs"), reply.alias("reply"))
    post = F.struct("uri", author.alias("author"), record.alias("record"), F.col("reply_count").alias("replyCount"), F.col("repost_count").alias("repostCount"), F.col("like_count").alias("likeCount"), stamp.alias("indexedAt"))
    return t.posts.groupBy(F.floor(F.col("post_id") / 50).alias("page")).agg(F.to_json(F.struct(F.collect_list(post).alias("posts"), F.lit("next").alias("cursor"))).alias("body"))


register("src_search_json", lambda t: s.search_posts(pages(t), "body").withColumn("published_at", F.col("published_at").cast("timestamp_ntz")), "SELECT uri AS source_post_id, author_id, author_handle, published_at, text, lang, in_reply_to, reply_count, repost_count, like_count FROM posts")


def threads(t):
    """The first four turns of a conversation, each replying to the one before."""
    uri = lambda n: F.concat("conv_id", F.lit(f"/{n}"))
    turns = t.conversations.where("turn < 4").groupBy("conv_id").agg(*[F.max(F.when(F.col("turn") == n, F.col("role"))).alias(f"r{n}") for n in range(4)])
    post = lambda n: F.struct(uri(n).alias("uri"), F.struct(F.col(f"r{n}").alias("did"), F.col(f"r{n}").alias("handle")).alias("author")).alias("post")
    below = lambda n, inner: F.when(F.col(f"r{n}").isNotNull(), F.array(inner)).otherwise(F.array().cast("array<string>") if n == 3 else F.lit(None)).alias("replies")
    level2 = F.struct(post(2), below(3, uri(3)))
    level1 = F.struct(post(1), below(2, level2))
    return turns.select(uri(0).alias("seed_uri"), F.to_json(F.struct(F.struct(post(0), below(1, level1)).alias("thread"))).alias("body"))


register("thread_edges", lambda t: s.thread_edges(threads(t), "body"), """WITH c AS (SELECT conv_id, turn, max(role) AS role FROM conversations WHERE turn < 4 GROUP BY 1, 2)
      SELECT conv_id || '/1' AS source, conv_id || '/0' AS target, role AS actor, 1 AS depth, false AS deeper FROM c WHERE turn = 1
      UNION ALL SELECT a.conv_id || '/2', a.conv_id || '/1', a.role, 2, EXISTS (SELECT 1 FROM c d WHERE d.conv_id = a.conv_id AND d.turn = 3) FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = 1 WHERE a.turn = 2""")
