"""Feeds and forum lists as rows of posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ITEM = "title: string, link: string, description: string, pubDate: string, guid: string, author: string, `dc:date`: string, `dc:creator`: string"
_ENTRY = "title: string, link: struct<_href: string>, summary: string, content: string, published: string, updated: string, id: string, author: struct<name: string>"
#: RSS 2.0 has channel, Atom has entry.
FEED = f"channel struct<item: array<struct<{_ITEM}>>>, entry array<struct<{_ENTRY}>>"
FORUM = """topic_list struct<topics: array<struct<id: bigint, title: string, excerpt: string, slug: string, created_at: string, posts_count: bigint, like_count: bigint,
  posters: array<struct<user_id: bigint>>>>>"""
MOST = 8000


def clean(html: Column) -> Column:
    """Without tags, the five named entities and repeated blanks."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def feed_time(text: Column) -> Column:
    """The date of a feed: RFC 822, with or without the weekday, or ISO 8601. Null if it is neither."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, *", ""), " (GMT|UTC?|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(F.trim(text)))


def _joined(title: Column, body: Column) -> Column:
    return F.substring(F.when(body != "", F.trim(F.concat(title, F.lit(". "), body))).otherwise(title), 1, MOST)


def _within(rows: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """Both ends count."""
    rows = rows.where(F.col("published_at") >= F.lit(since).cast("timestamp")) if since else rows
    return rows.where(F.col("published_at") <= F.lit(until).cast("timestamp")) if until else rows


def rss_posts(bodies: DataFrame, body: str, source: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """A row for each item or entry with a date and a title or a body. The id is a digest of source and guid (else link, else
    title). A body that is no such XML gives no rows."""
    feed = bodies.select(F.from_xml(F.col(body), FEED, {"mode": "PERMISSIVE"}).alias("f"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    own = lambda *cs: F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cs))
    i, e = "i.", "e."
    items = feed.select(F.explode("f.channel.item").alias("i")).select(
        blank(F.col(i + "title")).alias("title"), clean(F.col(i + "description")).alias("body"), feed_time(own(F.col(i + "pubDate"), F.col("i.`dc:date`"))).alias("published_at"),
        own(F.col(i + "link")).alias("url"), own(F.col(i + "guid")).alias("guid"), own(F.col(i + "author"), F.col("i.`dc:creator`")).alias("author"),
    )
    entries = feed.select(F.explode("f.entry").alias("e")).select(
        blank(F.col(e + "title")).alias("title"), clean(own(F.col(e + "summary"), F.col(e + "content"))).alias("body"), feed_time(own(F.col(e + "published"), F.col(e + "updated"))).alias("published_at"),
        own(F.col(e + "link._href")).alias("url"), own(F.col(e + "id")).alias("guid"), own(F.col(e + "author.name")).alias("author"),
    )
    rows = items.unionByName(entries).where("published_at is not null and (title <> '' or body <> '')")
    author = F.coalesce("author", F.lit(source))
    digest = lambda c: F.sha1(F.concat(F.lit(f"{source}:"), c))
    rows = rows.select(
        digest(F.coalesce("guid", "url", "title")).alias("source_post_id"), F.concat(F.lit(f"{source}:"), F.substring(F.sha1(author), 1, 12)).alias("author_id"),
        F.substring(author, 1, 120).alias("author_handle"), "published_at", _joined(F.col("title"), F.col("body")).alias("text"), "url",
    )
    return _within(rows, since, until)


def forum_posts(bodies: DataFrame, body: str, source: str, base_url: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """A row for each dated topic of a forum's list, the excerpt without its tags."""
    rows = bodies.select(F.explode(F.from_json(body, FORUM)["topic_list"]["topics"]).alias("t")).select("t.*")
    title, excerpt = F.coalesce(F.trim("title"), F.lit("")), clean(F.col("excerpt"))
    poster = F.coalesce(F.get("posters", F.lit(0))["user_id"].cast("string"), F.lit("?"))
    rows = rows.select(
        F.concat(F.lit(f"{source}:"), F.col("id").cast("string")).alias("source_post_id"), F.concat(F.lit(f"{source}:"), poster).alias("author_id"), F.try_to_timestamp("created_at").alias("published_at"),
        _joined(title, excerpt).alias("text"), F.concat(F.lit(base_url.rstrip("/") + "/t/"), "slug", F.lit("/"), F.col("id").cast("string")).alias("url"),
        F.col("posts_count").alias("reply_count"), "like_count",
    )
    return _within(rows.where("published_at is not null"), since, until)
