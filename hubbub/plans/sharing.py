"""Links, shared sources, replies within the corpus and label migration over the adapted posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubbub.operators import sharing as s
from hubbub.operators.descriptive import top
from hubbub.plans.catalog import register
from hubbub.plans.quality_checks import _AB, flows, version
from hubbub.plans.signals import FLAGGED_SQL, flagged

ALIASES = {"blog.example.net": "sec.example.org", "cdn.example.com": "news.example.com"}
STOP = ["short.example", "feeds.example"]


def with_payload(posts):
    """A link in a facet of every fifth post, an embedded one in every seventh."""
    facet = F.when(F.col("post_id") % 5 == 0, F.array(F.struct(F.array(F.struct(F.concat(F.lit("https://cdn.example.com/f/"), F.col("k") % 3).alias("uri")), F.struct(F.lit(None).cast("string").alias("uri"))).alias("features"))))
    embed = F.when(F.col("post_id") % 7 == 0, F.struct(F.struct(F.concat(F.lit("https://short.example/"), F.col("k"), F.lit(").")).alias("uri")).alias("external")))
    return posts.withColumn("payload", F.to_json(F.struct(F.struct(facet.alias("facets")).alias("record"), embed.alias("embed"))))


def links():
    return s.post_links(F.col("text"), F.col("payload"))


def domains(t):
    return s.shared_domains(with_payload(flagged(t)), links(), ALIASES, STOP)


_URLS = r"""regexp_extract_all(text, '(https?://[^\s<>"'']+)', 1)"""
_LINKS = f"""list_transform({_URLS}, lambda u: rtrim(u, '.,;)')) || CASE WHEN post_id % 5 = 0 THEN ['https://cdn.example.com/f/' || (k % 3)] ELSE [] END
      || CASE WHEN post_id % 7 = 0 THEN ['https://short.example/' || k] ELSE [] END"""
register(
    "extract_urls", lambda t: with_payload(t.posts).select("post_id", F.array_join(links(), " ").alias("urls")).where("urls <> ''"),
    f"SELECT post_id, array_to_string({_LINKS}, ' ') AS urls FROM posts WHERE len({_LINKS}) > 0",
)
_ALIAS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items())
_DOM = rf"""{FLAGGED_SQL}, ln AS (SELECT post_id, author_id, broadcast, unnest({_LINKS}) AS u FROM flagged),
    dn AS (SELECT post_id, author_id, broadcast, regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\.', '') AS name FROM ln),
    dm AS (SELECT DISTINCT post_id, author_id, broadcast, CASE name {_ALIAS} ELSE name END AS domain FROM dn WHERE name NOT IN ({', '.join(f"'{x}'" for x in STOP)}))"""
register("coshare_domains", lambda t: domains(t).groupBy("domain", "author_id").agg(F.count(F.lit(1)).alias("posts")), f"WITH {_DOM} SELECT domain, author_id, count(*) AS posts FROM dm GROUP BY 1, 2")
register(
    "source_uptake", lambda t: top(s.uptake(domains(t)), 18, F.desc("organic"), "domain"),
    f"""WITH {_DOM}, g AS (SELECT domain, count(DISTINCT author_id) FILTER (NOT broadcast) AS organic, count(DISTINCT author_id) FILTER (broadcast) AS broadcast, count(*) AS posts FROM dm GROUP BY 1)
      SELECT * FROM (SELECT *, row_number() OVER (ORDER BY organic DESC, domain) AS place FROM g WHERE organic + g.broadcast >= 3) WHERE place <= 18""",
)
register(
    "single_author_domains", lambda t: s.repeated_by_one(domains(t)),
    f"WITH {_DOM}, g AS (SELECT domain, count(DISTINCT author_id) = 1 AND count(*) >= 3 AS one FROM dm GROUP BY 1) SELECT count(*) AS domains, count(*) FILTER (one) AS of_one_author FROM g",
)


def rooted(t):
    return t.posts.withColumn("root_uri", F.when(F.col("k") % 2 == 0, F.concat(F.lit("at://p/"), (F.col("post_id") - F.col("post_id") % 20).cast("string"))))


register(
    "corpus_reply_edges", lambda t: s.reply_edges(rooted(t)),
    "SELECT a.post_id AS reply, b.post_id AS parent, CASE WHEN a.k % 2 = 0 THEN 'at://p/' || (a.post_id - a.post_id % 20) ELSE a.in_reply_to END AS thread FROM posts a JOIN posts b ON a.in_reply_to = b.uri",
)


def migrated(t):
    both = version(t, "v1").where("is_relevant").select("post_id").join(version(t, "v2").select("post_id"), "post_id")
    return s.migration_summary(flows(t), both.select((F.col("post_id") % 9 == 2).alias("off_topic")))


register(
    "label_migration_summary", migrated,
    f"""WITH f AS (SELECT a.post_id, coalesce(a.topic_key, 'other') AS x, coalesce(b.topic_key, 'other') AS y FROM {_AB} WHERE a.is_relevant)
      SELECT count(*) AS posts, count(*) FILTER (x <> y) AS changed, count(*) FILTER (x = 'other' AND y <> 'other') AS out_of_other, count(*) FILTER (x <> 'other' AND y = 'other') AS into_other,
        round(count(*) FILTER (x = 'other') / count(*), 6) AS other_before, round(count(*) FILTER (y = 'other') / count(*), 6) AS other_after, count(*) FILTER (post_id % 9 = 2) AS off_topic FROM f""",
)
