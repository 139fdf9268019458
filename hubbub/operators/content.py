"""Text, links and identifiers of posts: normalising, de-duplicating, extracting, upserting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_URL = r"https?://[^\s<>\"']+"


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, " \x00", " "), r"\s+", " "))


def text_hash(text: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, _URL, ""), r"\s+", " "))
    return F.sha2(F.lower(bare), 256)


def extract_urls(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({_URL})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.rtrim(u, F.lit(".,;)"))))


def url_domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")


def html_clean(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))


def parse_post_time(text: Column) -> Column:
    """ISO with or without fraction and zone, more than six digits of fraction cut, without zone taken as UTC; then the mail
    format; else NULL."""
    cut = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    iso = F.try_to_timestamp(cut)
    mail = F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(F.when(F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:")), iso), mail)


def resolve_published_at(rows: DataFrame) -> DataFrame:
    """created_at and indexed_at: claimed times more than an hour ahead or two days behind give way to the indexed one."""
    reason = F.when(F.col("created_at") > F.col("indexed_at") + F.expr("interval 1 hour"), "future_createdAt")
    reason = reason.when(F.col("created_at") < F.col("indexed_at") - F.expr("interval 2 days"), "backdated_createdAt")
    return rows.withColumn("reason", reason).withColumn("published_at", F.when(F.col("reason").isNull(), F.col("created_at")).otherwise(F.col("indexed_at")))


def exact_dup_clusters(posts: DataFrame) -> DataFrame:
    rows = posts.withColumn("hash", text_hash(F.col("text"))).groupBy("hash")
    return rows.agg(F.count(F.lit(1)).alias("size"), F.min_by("post_id", F.struct("published_at", "post_id")).alias("first_post"), F.countDistinct("author_id").alias("authors")).where("size > 1")


def dedup_batch(posts: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    return posts.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(arrival))).where("nth = 1").drop("nth")


def upsert_posts(existing: DataFrame, batch: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The rows to append."""
    return dedup_batch(batch, keys, arrival).join(existing.select(*keys), keys, "left_anti")


def upsert_counts(fresh: DataFrame, batch: DataFrame) -> DataFrame:
    """One row: rows of batch that upsert_posts appends, and the others."""
    kinds = batch.select(F.lit(0).alias("new")).unionAll(fresh.select(F.lit(1).alias("new")))
    return kinds.agg(F.sum("new").alias("inserted"), (F.count_if(F.col("new") == 0) - F.sum("new")).alias("duplicates"))


def upsert_labels(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Replace on (post_id, label_version)."""
    both = existing.withColumn("age", F.lit(1)).unionByName(new.withColumn("age", F.lit(0)))
    return both.withColumn("nth", F.row_number().over(W.partitionBy("post_id", "label_version").orderBy("age"))).where("nth = 1").drop("nth", "age")


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label_version").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_relevant").alias("n_relevant"), F.count_if("low_info").alias("n_low_info"))


# vulnerability identifiers
def extract_cves(posts: DataFrame) -> DataFrame:
    """post_id, cve_id (upper case), char_start (from 0) of each identifier's first place; one with more digits does not count."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?i)\b(CVE-\d{4}-\d{4,7})\b"), F.lit(1)), lambda c: F.upper(c)))
    rows = posts.where(F.col("text").rlike(r"(?i)\bCVE-\d{4}-\d")).select("post_id", "text", F.explode(found).alias("cve_id"))
    # the place of the identifier as such: what precedes its first bounded occurrence
    head = F.call_function("regexp_extract", F.col("text"), F.concat(F.lit(r"(?is)^(.*?)\b"), F.col("cve_id"), F.lit(r"\b")), F.lit(1))
    return rows.select("post_id", "cve_id", F.length(head).cast("long").alias("char_start"))


def link_corpus(posts: DataFrame, linked: DataFrame) -> DataFrame:
    return extract_cves(posts.join(linked.select("post_id"), "post_id", "left_anti"))


def merge_kev(records: DataFrame, kev: DataFrame) -> DataFrame:
    """kev: cve_id, kev_date. Sets the flag and date, adds what is missing, keeps the rest."""
    rows = records.join(kev.withColumn("listed", F.lit(True)), "cve_id", "full")
    return rows.select("cve_id", "cvss", F.coalesce("listed", "known_exploited").alias("known_exploited"), F.col("kev_date"))


def top_cves(mentions: DataFrame, posts: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """Score and exploitation stay separate columns."""
    rows = mentions.select("post_id", "cve_id").distinct().join(posts.select("post_id", "source_key", "published_at"), "post_id")
    rows = rows.groupBy("cve_id").agg(F.count(F.lit(1)).alias("posts"), F.countDistinct("source_key").alias("sources"), F.max("published_at").alias("last_seen"))
    rows = rows.withColumn("place", F.row_number().over(W.orderBy(F.desc("posts"), "cve_id"))).where(F.col("place") <= k)
    return rows.join(records, "cve_id", "left")


def cve_ids(text: Column) -> Column:
    """The distinct ids of a text, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(CVE-\d{4}-\d{4,7})\b"), F.lit(1)), F.upper)))


def kev_top(mentions: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """The k ids mentioned most, and whether they are known to be exploited."""
    counts = mentions.groupBy("cve_id").agg(F.count(F.lit(1)).alias("mentions")).orderBy(F.desc("mentions"), "cve_id").limit(k)
    rows = counts.withColumn("place", F.row_number().over(W.orderBy(F.desc("mentions"), "cve_id")))  # k rows
    return rows.join(records.select("cve_id", "known_exploited"), "cve_id", "left").withColumn("known_exploited", F.coalesce("known_exploited", F.lit(False)))


def cve_daily_vector(mentions: DataFrame, posts: DataFrame, as_of: str, days: int) -> DataFrame:
    """Of each id the mentions on each of the days before as_of, oldest first, and the total of as many days before those."""
    end = F.lit(as_of).cast("date")
    rows = mentions.select("post_id", "cve_id").join(posts.select("post_id", F.to_date("published_at").alias("day")), "post_id")
    back = F.date_diff(end, "day")  # 1 is the last day
    each = [F.count_if(back == n).cast("string") for n in range(days, 0, -1)]
    return rows.groupBy("cve_id").agg(F.concat_ws(",", *each).alias("daily"), F.count_if(back.between(days + 1, 2 * days)).alias("before"))


# registry of outside events
_LEGAL = r"\s+(inc|ltd|llc|corp|gmbh|sa|plc|co)$"


def canonical_name(text: Column, is_domain: Column) -> Column:
    domain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"^[a-z]+://", ""), r"/.*$", "")
    org = F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))
    return F.when(is_domain, F.regexp_replace(domain, r"^www\.", "")).otherwise(F.regexp_replace(org, _LEGAL, ""))


def ingest_events(raw: DataFrame, since: str, until: str) -> DataFrame:
    """Published, else discovered; days since..until, both inclusive; no name or time, no event."""
    rows = raw.withColumn("at", F.coalesce("published_at", "discovered_at")).where("name is not null and at is not null")
    return rows.where((F.to_date("at") >= F.lit(since).cast("date")) & (F.to_date("at") <= F.lit(until).cast("date"))).dropDuplicates(["event_id"]).select("event_id", "name", "country", "at")


def event_entities(events: DataFrame) -> DataFrame:
    parts = F.array(F.struct(F.col("name").alias("entity"), F.lit(False).alias("is_domain")), F.struct(F.col("website").alias("entity"), F.lit(True).alias("is_domain")))
    rows = events.select("event_id", "country", F.explode(parts).alias("e")).where("e.entity is not null")
    return rows.select("event_id", "country", "e.entity", "e.is_domain", canonical_name(F.col("e.entity"), F.col("e.is_domain")).alias("canonical"))


def usable_entity(entities: DataFrame, home: str) -> DataFrame:
    """Long enough to mean something; names that home events share leave the foreign set."""
    org = ~F.col("is_domain") & (F.length("canonical") >= 8) & (F.size(F.split("canonical", " ")) >= 2)
    domain = F.col("is_domain") & F.col("canonical").contains(".") & (F.length("canonical") >= 7)
    rows = entities.where(org | domain)
    at_home = rows.where(F.col("country") == home).select("canonical").distinct()
    return rows.where(F.col("country") == home).unionByName(rows.where(F.col("country") != home).join(at_home, "canonical", "left_anti").select(rows.columns))


def enrich_queue(mentions: DataFrame, relevant: DataFrame, records: DataFrame, known: DataFrame, min_posts: int = 2) -> DataFrame:
    """Identifiers to look up: not known yet, and in a relevant post, known exploited, or in min_posts posts. tier gives the order:
    relevant ones first, exploited ones first among equals, then by posts.

    mentions: cve_id, post_id. relevant: post_id. records: cve_id, known_exploited. known: cve_id."""
    seen = relevant.select("post_id").distinct().withColumn("seen", F.lit(True))
    rows = mentions.join(seen, "post_id", "left").groupBy("cve_id").agg(F.countDistinct("post_id").alias("posts"), F.bool_or(F.coalesce("seen", F.lit(False))).alias("in_relevant"))
    rows = rows.join(records.select("cve_id", "known_exploited"), "cve_id", "left").withColumn("kev", F.coalesce("known_exploited", F.lit(False)))
    rows = rows.where(F.col("in_relevant") | F.col("kev") | (F.col("posts") >= min_posts)).join(known.select("cve_id"), "cve_id", "left_anti")
    tier = F.when(F.col("in_relevant") & F.col("kev"), 1).when(F.col("in_relevant"), 2).when(F.col("kev"), 3).otherwise(4)
    return rows.select("cve_id", "posts", "kev", "in_relevant", tier.alias("tier"))


def nearest_event(matches: DataFrame) -> DataFrame:
    """Of equal distances the earlier id."""
    return matches.groupBy("post_id").agg(F.min_by(F.struct("event_id", "delta"), F.struct(F.abs("delta"), "event_id")).alias("e")).select("post_id", "e.event_id", "e.delta")


# information
def effective_tokens(text: Column) -> Column:
    """Without links, mentions and signs."""
    bare = F.regexp_replace(F.regexp_replace(text, _URL, " "), r"@\w+", " ")
    return F.filter(F.split(bare, r"[^A-Za-z0-9]+"), lambda t: t != "")
