"""Feeds, forum lists, quote and repost pages, thread gaps and stored bodies: written from the adapted posts, edges and
conversations first, then read."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubbub.operators import interaction
from hubbub.plans.catalog import register
from hubbub.plans.payloads import threads
from hubbub.sources import feeds, payloads


def _escaped(column):
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        column = F.replace(column, F.lit(sign), F.lit(name))
    return column


def feed_bodies(t):
    """Fifty posts a body, RSS and Atom in turn; some items lack a title, a guid, an author or a date."""
    p = t.posts.withColumn("page", F.floor(F.col("post_id") / 50))
    tag = lambda name, value: F.coalesce(F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>")), F.lit(""))
    title = F.when(F.col("post_id") % 5 > 0, F.concat(F.lit("Post "), F.col("post_id").cast("string")))
    guid, author = F.when(F.col("post_id") % 7 > 0, F.col("uri")), F.when(F.col("post_id") % 6 > 0, F.col("author_handle"))
    dated = F.col("post_id") % 11 > 0
    link = F.concat(F.lit("https://feed.example.org/"), F.col("post_id").cast("string"))
    body = _escaped(F.concat(F.lit("<p>"), _escaped(F.col("text")), F.lit("</p>")))
    rss = F.concat(
        F.lit("<item>"), tag("title", title), tag("link", link), tag("description", body), tag("guid", guid), tag("author", author),
        tag("pubDate", F.when(dated, F.concat(F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))), F.lit("</item>"),
    )
    atom = F.concat(
        F.lit("<entry>"), tag("title", title), F.lit('<link href="'), link, F.lit('"/>'), tag("summary", body), tag("id", guid), tag("author", tag("name", author)),
        tag("published", F.when(dated, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))), F.lit("</entry>"),
    )
    items = p.groupBy("page").agg(F.array_join(F.collect_list(F.when(F.col("page") % 2 == 0, rss).otherwise(atom)), "").alias("items"))
    whole = F.when(F.col("page") % 2 == 0, F.concat(F.lit("<rss version='2.0'><channel>"), "items", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit("<feed>"), "items", F.lit("</feed>")))
    return items.select(whole.alias("body"))


_CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_SINCE, _UNTIL = "2024-01-03 00:00:00", "2024-01-27 12:00:00"
register(
    "src_rss",
    lambda t: feeds.rss_posts(feed_bodies(t), "body", "feed", _SINCE, _UNTIL).withColumn("published_at", F.col("published_at").cast("timestamp_ntz")),
    f"""WITH f AS (SELECT *, CASE WHEN post_id % 5 > 0 THEN 'Post ' || post_id ELSE '' END AS title, 'https://feed.example.org/' || post_id AS url, CASE WHEN post_id % 6 > 0 THEN author_handle ELSE 'feed' END AS author FROM posts),
      g AS (SELECT *, CASE WHEN post_id % 7 > 0 THEN uri ELSE url END AS guid, CAST(date_trunc('second', published_at) AS TIMESTAMP) AS dated, {_CLEAN} AS body FROM f WHERE post_id % 11 > 0)
      SELECT sha1('feed:' || guid) AS source_post_id, 'feed:' || substr(sha1(author), 1, 12) AS author_id, author AS author_handle, dated AS published_at,
        trim(title || '. ' || body) AS text, url FROM g WHERE dated >= TIMESTAMP '{_SINCE}' AND dated <= TIMESTAMP '{_UNTIL}'""",
)


def forum_bodies(t):
    stamp = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    poster = F.when(F.col("post_id") % 4 > 0, F.array(F.struct(F.substring("author_id", 2, 20).cast("long").alias("user_id"))))
    excerpt = F.when(F.col("post_id") % 3 > 0, F.concat(F.lit("<p>"), "text", F.lit("</p>")))
    topic = F.struct(
        F.col("post_id").alias("id"), F.concat(F.lit(" Topic "), F.col("post_id").cast("string")).alias("title"), excerpt.alias("excerpt"), F.concat(F.lit("topic-"), F.col("post_id").cast("string")).alias("slug"),
        F.when(F.col("post_id") % 13 > 0, stamp).alias("created_at"), F.col("reply_count").alias("posts_count"), "like_count", poster.alias("posters"),
    )
    topics = t.posts.groupBy(F.floor(F.col("post_id") / 30).alias("page")).agg(F.collect_list(topic).alias("topics"))
    return topics.select(F.to_json(F.struct(F.struct("topics").alias("topic_list"))).alias("body"))


register(
    "src_discourse",
    lambda t: feeds.forum_posts(forum_bodies(t), "body", "forum", "https://forum.example.org/", _SINCE, _UNTIL).withColumn("published_at", F.col("published_at").cast("timestamp_ntz")),
    f"""SELECT 'forum:' || post_id AS source_post_id, 'forum:' || CASE WHEN post_id % 4 > 0 THEN substr(author_id, 2) ELSE '?' END AS author_id, published_at,
      'Topic ' || post_id || CASE WHEN post_id % 3 > 0 THEN '. ' || {_CLEAN} ELSE '' END AS text, 'https://forum.example.org/t/topic-' || post_id || '/' || post_id AS url, reply_count, like_count
      FROM posts WHERE post_id % 13 > 0 AND published_at >= TIMESTAMP '{_SINCE}' AND published_at <= TIMESTAMP '{_UNTIL}'""",
)


def quote_pages(t):
    """A body for each seed: embeds of the seed directly, within another record, or of another post."""
    at = lambda n: F.concat(F.lit("at://p/"), n.cast("string"))
    no = F.col("edge_no") % 3
    direct = F.when(no == 0, at(F.col("seed_id"))).when(no == 2, at(F.col("seed_id") + 1))
    inner = F.when(no == 1, F.struct(at(F.col("seed_id")).alias("uri")))
    record = F.struct(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("createdAt"), F.struct(F.struct(direct.alias("uri"), inner.alias("record")).alias("record")).alias("embed"))
    post = F.struct(F.concat(F.lit("at://q/"), F.col("edge_no").cast("string")).alias("uri"), F.struct(F.col("actor").alias("did")).alias("author"), record.alias("record"))
    rows = t.edges.where("edge_type = 'quote'").groupBy("seed_id").agg(F.collect_list(post).alias("posts"))
    return rows.select(at(F.col("seed_id")).alias("seed_uri"), F.to_json(F.struct("posts")).alias("body"))


def repost_pages(t):
    account = F.struct(F.col("actor").alias("did"), F.concat(F.lit("@"), "actor").alias("handle"))
    rows = t.edges.where("edge_type = 'repost'").groupBy("seed_id").agg(F.collect_list(account).alias("repostedBy"))
    return rows.select(F.concat(F.lit("at://p/"), F.col("seed_id").cast("string")).alias("seed_uri"), F.to_json(F.struct("repostedBy")).alias("body"))


register(
    "quote_edges", lambda t: payloads.quote_edges(quote_pages(t), "body", "seed_uri").withColumn("event_time", F.col("event_time").cast("timestamp_ntz")),
    "SELECT 'at://q/' || edge_no AS source, 'at://p/' || seed_id AS target, actor, event_time, edge_no % 3 < 2 AS consistent FROM edges WHERE edge_type = 'quote'",
)
register(
    "repost_edges", lambda t: payloads.repost_edges(repost_pages(t), "body", "seed_uri").withColumn("event_time", F.col("event_time").cast("timestamp_ntz")),
    "SELECT CAST(NULL AS VARCHAR) AS source, 'at://p/' || seed_id AS target, actor, '@' || actor AS handle, CAST(NULL AS TIMESTAMP) AS event_time FROM edges WHERE edge_type = 'repost'",
)


def gap_bodies(t):
    """Each conversation's turns as direct replies of its first; every third turn was removed, odd ones have a reply."""
    kind = lambda gone: F.when(gone, F.lit("x#notFoundPost")).otherwise(F.lit("x#threadViewPost")).alias("$type")
    below = F.when(F.col("turn") % 2 == 1, F.array(F.struct(kind(F.col("turn") % 5 == 0))))
    reply = F.when(F.col("turn") > 0, F.struct(kind(F.col("turn") % 3 == 0), below.alias("replies")))
    rows = t.conversations.groupBy("conv_id").agg(F.array_compact(F.collect_list(reply)).alias("replies"), F.count_if(F.expr("turn > 0")).alias("n"), F.max("turn").alias("last"))
    post = F.struct((F.col("n") + (F.col("last") % 2)).alias("replyCount"))
    return rows.select("conv_id", F.to_json(F.struct(F.struct(post.alias("post"), "replies").alias("thread"))).alias("body"))


register("thread_gap", lambda t: payloads.thread_gap(gap_bodies(t), "body", "conv_id"), """WITH c AS (SELECT conv_id, count(*) FILTER (turn > 0) AS n, max(turn) AS last, count(*) FILTER (turn % 2 = 1) AS below,
      count(*) FILTER (turn > 0 AND turn % 3 = 0) + count(*) FILTER (turn % 2 = 1 AND turn % 5 = 0) AS unread FROM conversations GROUP BY 1)
    SELECT conv_id, CAST(n + last % 2 AS BIGINT) AS reply_count, n AS returned_depth1, below AS returned_depth2, n + below AS returned_nodes, unread AS unread_nodes, last % 2 > 0 AS partial FROM c""")


def stored_bodies(t):
    """A body for each twenty posts; some were altered after they were hashed, some stored JSON has other values."""
    rows = t.posts.groupBy(F.floor(F.col("post_id") / 20).alias("page")).agg(F.sum("reply_count").alias("replies"), F.max("uri").alias("last"))
    rows = rows.withColumn("body", F.to_json(F.struct("last", "replies", "page")))
    rows = payloads.pack_bodies(rows, "body").withColumn("digest", F.when(F.col("page") % 10 == 3, F.lit("0")).otherwise(F.col("digest")))
    return rows.withColumn("payload", F.to_json(F.struct("page", F.when(F.col("page") % 10 == 5, -1).otherwise(F.col("replies")).alias("replies"), "last")))


register("qa_snapshot_hash", lambda t: payloads.check_bodies(stored_bodies(t), "packed", "digest", "payload"), """WITH p AS (SELECT DISTINCT CAST(floor(post_id / 20) AS BIGINT) AS page FROM posts)
    SELECT count(*) AS checked, count(*) FILTER (page % 10 = 3) AS digest_mismatch, count(*) FILTER (page % 10 = 5) AS json_mismatch FROM p""")


def snapshots(t):
    """The bodies of all three endpoints; those of every seventh seed failed."""
    failed = F.substring("seed_uri", 8, 20).cast("long") % 140 == 0
    kinds = {"thread": threads(t).withColumn("ok", F.lit(True)), "quotes": quote_pages(t).withColumn("ok", ~failed), "reposts": repost_pages(t).withColumn("ok", ~failed)}
    parts = [d.select(F.concat(F.lit(f"{name}:"), "seed_uri").alias("snapshot_id"), F.lit(name).alias("endpoint"), "seed_uri", "ok", "body") for name, d in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def derived(t):
    """The reposts of accounts whose name ends in 5 were derived before."""
    target = F.concat(F.lit("at://p/"), F.col("seed_id").cast("string"))
    known = t.edges.where("edge_type = 'repost' and actor like '%5'").select(F.concat(F.lit("reposts:"), target).alias("snapshot_id"), interaction.edge_key(F.col("edge_type"), F.col("actor"), target).alias("key"))
    return interaction.derive_run(payloads.snapshot_edges(snapshots(t)), known)


register("derive_run", derived, """WITH c AS (SELECT conv_id, turn, max(role) AS role FROM conversations WHERE turn < 4 GROUP BY 1, 2),
      re AS (SELECT 'thread:' || conv_id || '/0' AS snapshot_id, 'reply' AS edge_type, conv_id || '/1' AS source, conv_id || '/0' AS target, role AS actor, 1 AS depth FROM c WHERE turn = 1
        UNION ALL SELECT 'thread:' || a.conv_id || '/0', 'reply', a.conv_id || '/2', a.conv_id || '/1', a.role, 2 FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = 1 WHERE a.turn = 2),
      qu AS (SELECT 'quotes:at://p/' || seed_id, 'quote', 'at://q/' || edge_no, 'at://p/' || seed_id, actor, NULL FROM edges WHERE edge_type = 'quote' AND seed_id % 140 <> 0),
      rp AS (SELECT 'reposts:at://p/' || seed_id, 'repost', NULL, 'at://p/' || seed_id, actor, NULL FROM edges WHERE edge_type = 'repost' AND seed_id % 140 <> 0 AND actor NOT LIKE '%5'),
      body AS (SELECT * FROM re UNION ALL SELECT * FROM qu),
      al AS (SELECT * FROM body UNION ALL SELECT * FROM rp UNION ALL SELECT snapshot_id, 'author', NULL, source, actor, NULL FROM body
        UNION ALL SELECT 'thread:' || conv_id || '/0', 'author', NULL, conv_id || '/0', max(role) FILTER (turn = 0), NULL FROM c GROUP BY conv_id)
      SELECT DISTINCT snapshot_id, substr(sha256(edge_type || '|' || coalesce(source, actor, 'None') || '|' || target), 1, 32) AS key, edge_type, source, target, actor, depth FROM al""")
