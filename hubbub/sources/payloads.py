"""Collected JSON bodies as rows: search pages, reply threads, quotes and reposts; and checks of what was stored."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

_AUTHOR = "struct<did: string, handle: string>"
SEARCH_PAGE = f"""posts array<struct<uri: string, author: {_AUTHOR}, record: struct<createdAt: string, text: string, langs: array<string>, reply: struct<parent: struct<uri: string>>>,
  replyCount: bigint, repostCount: bigint, likeCount: bigint, indexedAt: string>>, cursor string"""
_LEAF = f"struct<post: struct<uri: string, author: {_AUTHOR}>, replies: array<string>>"
_REPLY = f"struct<post: struct<uri: string, author: {_AUTHOR}>, replies: array<{_LEAF}>>"
THREAD = f"thread struct<post: struct<uri: string, author: {_AUTHOR}>, replies: array<{_REPLY}>>"


def search_posts(pages: DataFrame, body: str) -> DataFrame:
    """A row for each post of a page body: the claimed time, else the indexed one; the first language. A body that
    is no such JSON gives no rows."""
    rows = pages.select(F.explode(F.from_json(body, SEARCH_PAGE)["posts"]).alias("p")).select("p.*")
    time = lambda c: F.try_to_timestamp(c)
    return rows.select(
        F.col("uri").alias("source_post_id"), F.col("author.did").alias("author_id"), F.col("author.handle").alias("author_handle"), F.coalesce(time(F.col("record.createdAt")), time(F.col("indexedAt"))).alias("published_at"),
        F.col("record.text").alias("text"), F.get("record.langs", F.lit(0)).alias("lang"), F.col("record.reply.parent.uri").alias("in_reply_to"), F.col("replyCount").alias("reply_count"), F.col("repostCount").alias("repost_count"), F.col("likeCount").alias("like_count"),
    )


def thread_edges(threads: DataFrame, body: str, *keep: str) -> DataFrame:
    """Reply edges of the first two levels, and whether a second-level reply has more below it that is not read. Nodes
    without a readable post give none. keep names columns of threads that stay beside the edges, here and below."""
    root = threads.select(*keep, F.from_json(body, THREAD)["thread"].alias("t"))
    first = root.select(*keep, F.col("t.post.uri").alias("target"), F.explode("t.replies").alias("r")).where("r.post.uri is not null")
    second = first.select(*keep, F.col("r.post.uri").alias("target"), F.explode("r.replies").alias("r")).where("r.post.uri is not null")
    edge = lambda d, n, deeper: d.select(*keep, F.col("r.post.uri").alias("source"), "target", F.col("r.post.author.did").alias("actor"), F.lit(n).alias("depth"), deeper.alias("deeper"))
    return edge(first, 1, F.lit(False)).unionByName(edge(second, 2, F.coalesce(F.size("r.replies") > 0, F.lit(False))))


_EMBED = "struct<record: struct<uri: string, record: struct<uri: string>>>"
QUOTES = f"posts array<struct<uri: string, author: {_AUTHOR}, record: struct<createdAt: string, embed: {_EMBED}>, indexedAt: string>>"
REPOSTS = f"repostedBy array<{_AUTHOR}>"
_BELOW = "struct<`$type`: string>"
GAP = f"thread struct<post: struct<replyCount: bigint>, replies: array<struct<`$type`: string, replies: array<{_BELOW}>>>>"


def quote_edges(pages: DataFrame, body: str, seed_uri: str, *keep: str) -> DataFrame:
    """An edge for each quoting post of a page, with whether what it embeds, directly or within another record, is the seed."""
    rows = pages.select(*keep, F.col(seed_uri).alias("target"), F.explode(F.from_json(body, QUOTES)["posts"]).alias("q")).select(*keep, "target", "q.*")
    quoted = F.coalesce("record.embed.record.uri", "record.embed.record.record.uri")
    time = F.coalesce(F.try_to_timestamp("record.createdAt"), F.try_to_timestamp("indexedAt"))
    return rows.select(*keep, F.col("uri").alias("source"), "target", F.col("author.did").alias("actor"), time.alias("event_time"), F.coalesce(quoted == F.col("target"), F.lit(False)).alias("consistent"))


def repost_edges(pages: DataFrame, body: str, seed_uri: str, *keep: str) -> DataFrame:
    """An edge for each account of a page. Reposts have neither a post of their own nor a time."""
    rows = pages.select(*keep, F.col(seed_uri).alias("target"), F.explode(F.from_json(body, REPOSTS)["repostedBy"]).alias("a"))
    none = F.lit(None)
    return rows.select(*keep, none.cast("string").alias("source"), "target", F.col("a.did").alias("actor"), F.col("a.handle").alias("handle"), none.cast("timestamp").alias("event_time"))


def snapshot_edges(snapshots: DataFrame) -> DataFrame:
    """snapshot_id, edge_type, source, target, actor, depth of the relations in stored bodies: replies, quotes, reposts and
    the authors of the seed and of each reply and quote. snapshots: snapshot_id, endpoint (thread, quotes, reposts),
    seed_uri, ok, body. A failed snapshot, another endpoint or a body that is no such JSON gives none."""
    read = lambda endpoint: snapshots.where((F.col("endpoint") == endpoint) & F.col("ok"))
    none = F.lit(None).cast("int").alias("depth")
    edge = lambda d, kind, depth=none: d.select("snapshot_id", F.lit(kind).alias("edge_type"), "source", "target", "actor", depth)
    replies = thread_edges(read("thread"), "body", "snapshot_id")
    quotes = quote_edges(read("quotes"), "body", "seed_uri", "snapshot_id")
    reposts = repost_edges(read("reposts"), "body", "seed_uri", "snapshot_id")
    seeds = read("thread").select("snapshot_id", F.from_json("body", THREAD)["thread"]["post"].alias("p")).where("p.uri is not null")
    seeds = seeds.select("snapshot_id", F.lit(None).cast("string").alias("source"), F.col("p.uri").alias("target"), F.col("p.author.did").alias("actor"))
    wrote = replies.select("snapshot_id", "source", "actor").unionByName(quotes.select("snapshot_id", "source", "actor"))
    wrote = wrote.select("snapshot_id", F.lit(None).cast("string").alias("source"), F.col("source").alias("target"), "actor")
    out = edge(replies, "reply", F.col("depth"))
    for part in (edge(quotes, "quote"), edge(reposts, "repost"), edge(seeds.unionByName(wrote), "author")):
        out = out.unionByName(part)
    return out


def thread_gap(threads: DataFrame, body: str, key: str) -> DataFrame:
    """What a thread's post says of its replies beside what came: nodes of two levels, how many are no readable post, and
    whether direct replies are short of the count."""
    t = threads.select(key, F.from_json(body, GAP)["thread"].alias("t"))
    below = F.flatten(F.transform(F.col("replies"), lambda r: F.coalesce(r["replies"], F.array())))
    kinds = F.concat(F.transform("replies", lambda r: r["$type"]), F.transform("below", lambda r: r["$type"]))
    rows = t.withColumn("replies", F.col("t.replies")).where("t is not null")
    rows = rows.withColumn("below", F.coalesce(below, F.array().cast(f"array<{_BELOW}>"))).withColumn("kinds", F.coalesce(kinds, F.array().cast("array<string>")))
    count = F.coalesce("t.post.replyCount", F.lit(0)).cast("long")
    direct = F.greatest(F.coalesce(F.size("replies"), F.lit(0)), F.lit(0)).cast("long")
    unread = F.size(F.filter("kinds", lambda k: ~F.coalesce(k.endswith("#threadViewPost"), F.lit(False)))).cast("long")
    return rows.select(
        key, count.alias("reply_count"), direct.alias("returned_depth1"), F.size("below").cast("long").alias("returned_depth2"), F.size("kinds").cast("long").alias("returned_nodes"),
        unread.alias("unread_nodes"), (direct < count).alias("partial"),
    )


def check_bodies(snapshots: DataFrame, packed: str, digest: str, payload: str) -> DataFrame:
    """One row: bodies read, those whose digest is not the stored one, and those that are not the stored JSON, whatever the
    order of its names. Only unpacking needs Python."""

    def unpack(batches):
        for batch in batches:
            bodies = [gzip.decompress(b) for b in batch["packed"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary()), batch["digest"], batch["payload"]], ["body", "digest", "payload"])

    rows = snapshots.where(F.col(packed).isNotNull()).select(F.col(packed).alias("packed"), F.col(digest).alias("digest"), F.col(payload).alias("payload"))
    rows = rows.mapInArrow(unpack, "body binary, digest string, payload string")
    same = F.to_json(F.try_parse_json(F.col("body").cast("string"))) == F.to_json(F.try_parse_json("payload"))
    return rows.agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(~F.coalesce(F.sha2("body", 256) == F.col("digest"), F.lit(False))).alias("digest_mismatch"),
        F.count_if(~F.coalesce(same, F.lit(False))).alias("json_mismatch"),
    )


def pack_bodies(bodies: DataFrame, body: str) -> DataFrame:
    """bodies with the gzipped body `packed` and its digest, as collectors store them."""

    def pack(batches):
        for batch in batches:
            packed = [None if b is None else gzip.compress(b.encode(), mtime=0) for b in batch[body].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary())], [*batch.schema.names, "packed"])

    rows = bodies.mapInArrow(pack, StructType([*bodies.schema.fields, StructField("packed", BinaryType())]))
    return rows.withColumn("digest", F.sha2(F.col(body).cast("binary"), 256))
