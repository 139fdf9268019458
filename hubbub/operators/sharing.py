"""Links of posts and the sources that accounts share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubbub.operators.content import extract_urls, url_domain


def payload_links(payload: Column) -> Column:
    """Links that a post's JSON has beside its text, which often shows them cut: those of its facets, then the embedded one."""
    kind = "struct<record: struct<facets: array<struct<features: array<struct<uri: string>>>>>, embed: struct<external: struct<uri: string>>>"
    post = F.from_json(payload, kind)
    facets = F.flatten(F.transform(post["record"]["facets"], lambda f: F.coalesce(f["features"]["uri"], F.array().cast("array<string>"))))
    links = F.concat(F.coalesce(facets, F.array().cast("array<string>")), F.array(post["embed"]["external"]["uri"]))
    return F.filter(links, lambda u: u.isNotNull() & (u != ""))


def post_links(text: Column, payload: Column) -> Column:
    """Each link once, in order of text, facets and embed, without the signs that end a sentence."""
    more = F.coalesce(F.transform(payload_links(payload), lambda u: F.rtrim(u, F.lit(".,;)"))), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.coalesce(extract_urls(text), F.array().cast("array<string>")), more))


def shared_domains(posts: DataFrame, links: Column, aliases: dict[str, str], stop: list[str]) -> DataFrame:
    """post_id, author_id, broadcast, domain: what each post links to, once. aliases: other names of one source. stop: platforms
    and shorteners, which are no sources."""
    rows = posts.select("post_id", "author_id", "broadcast", F.explode(links).alias("url")).where(F.col("url").rlike("^https?://"))
    domain = url_domain(F.col("url"))
    if aliases:
        names = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
        domain = F.coalesce(names[domain], domain)
    rows = rows.select("post_id", "author_id", "broadcast", domain.alias("domain")).where(F.col("domain") != "")
    return rows.where(~F.col("domain").isin(stop)).distinct()


def uptake(domains: DataFrame, min_authors: int = 3) -> DataFrame:
    """domain, organic, broadcast, posts: accounts of each kind that cite a source, of those with at least min_authors. One row
    for each domain and account is made before accounts are counted."""
    each = domains.groupBy("domain", "author_id").agg(F.bool_or("broadcast").alias("broadcast"), F.count(F.lit(1)).alias("n"))
    rows = each.groupBy("domain").agg(F.count_if(~F.col("broadcast")).alias("organic"), F.count_if("broadcast").alias("broadcast"), F.sum("n").alias("posts"))
    return rows.where(F.col("organic") + F.col("broadcast") >= min_authors)


def repeated_by_one(domains: DataFrame, min_posts: int = 3) -> DataFrame:
    """One row: domains shared, and those that a single account shares in at least min_posts posts."""
    ends = domains.groupBy("domain").agg(F.min("author_id").alias("low"), F.max("author_id").alias("high"), F.count(F.lit(1)).alias("n"))
    return ends.agg(F.count(F.lit(1)).alias("domains"), F.count_if((F.col("low") == F.col("high")) & (F.col("n") >= min_posts)).alias("of_one_author"))


def reply_edges(posts: DataFrame) -> DataFrame:
    """reply, parent, thread: replies to posts of the corpus. thread: the root that the reply declares, else its parent's uri.

    posts: post_id, uri, in_reply_to, root_uri."""
    replies = posts.where("in_reply_to is not null").select(F.col("post_id").alias("reply"), F.col("in_reply_to").alias("to"), F.coalesce("root_uri", "in_reply_to").alias("thread"))
    return replies.join(posts.select(F.col("uri").alias("to"), F.col("post_id").alias("parent")), "to").select("reply", "parent", "thread")


def migration_summary(flows: DataFrame, judged: DataFrame) -> DataFrame:
    """One row: posts, changed, out_of_other, into_other, the share of `other` before and after, and off_topic, how many posts
    the second version calls off topic. flows: before, after, posts. judged: off_topic of the same posts."""
    n, other = F.col("posts"), F.lit("other")
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    before, after = F.col("before"), F.col("after")
    out = flows.agg(
        F.sum("posts").alias("posts"), total(before != after).alias("changed"), total((before == other) & (after != other)).alias("out_of_other"), total((before != other) & (after == other)).alias("into_other"),
        F.round(total(before == other) / F.sum("posts"), 6).alias("other_before"), F.round(total(after == other) / F.sum("posts"), 6).alias("other_after"),
    )
    return out.crossJoin(judged.agg(F.count_if("off_topic").alias("off_topic")))  # one row each
