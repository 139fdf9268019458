"""Text, lexicon, vulnerability and registry jobs over the adapted posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubbub.operators import content as c
from hubbub.operators.descriptive import top
from hubbub.operators.trend import in_window
from hubbub.plans.adapters import AS_OF
from hubbub.plans.catalog import register
from hubbub.plans.signals import _CUR

_URLS = r"""regexp_extract_all(text, '(https?://[^\s<>"'']+)', 1)"""
_HASH = r"""sha256(lower(trim(regexp_replace(regexp_replace(text, 'https?://[^\s<>"'']+', '', 'g'), '\s+', ' ', 'g'))))"""
register("normalize_text", lambda t: t.posts.select("post_id", c.normalize_text(F.col("text")).alias("text")), r"SELECT post_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM posts")
register("text_hash", lambda t: t.posts.select("post_id", c.text_hash(F.col("text")).alias("hash")), f"SELECT post_id, {_HASH} AS hash FROM posts")
register("exact_dup_clusters", lambda t: c.exact_dup_clusters(t.posts), f"SELECT {_HASH} AS hash, count(*) AS size, arg_min(post_id, (published_at, post_id)) AS first_post, count(DISTINCT author_id) AS authors FROM posts GROUP BY 1 HAVING count(*) > 1")
register("unique_urls", lambda t: t.relevant.select(F.explode(c.extract_urls(F.col("text"))).alias("url")).agg(F.countDistinct("url").alias("urls")), f"SELECT count(DISTINCT u) AS urls FROM (SELECT rtrim(unnest({_URLS}), '.,;)') AS u FROM relevant)")
register("html_clean", lambda t: t.pages.select("page_id", c.html_clean(F.col("html")).alias("text")), r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
register("parse_post_time", lambda t: t.posts.select("post_id", c.parse_post_time(F.concat(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z"))).cast("timestamp_ntz").alias("parsed")), "SELECT post_id, published_at AS parsed FROM posts")
_CLAIM = "claim AS (SELECT post_id, collected_at AS indexed_at, CASE post_id % 3 WHEN 0 THEN collected_at + INTERVAL 3 HOUR ELSE published_at END AS created_at FROM posts)"


def claims(t):
    return t.posts.select("post_id", F.col("collected_at").alias("indexed_at"), F.when(F.col("post_id") % 3 == 0, F.col("collected_at") + F.expr("interval 3 hours")).otherwise(F.col("published_at")).alias("created_at"))


register("resolve_published_at", lambda t: c.resolve_published_at(claims(t)), f"WITH {_CLAIM}, r AS (SELECT *, CASE WHEN created_at > indexed_at + INTERVAL 1 HOUR THEN 'future_createdAt' WHEN created_at < indexed_at - INTERVAL 2 DAY THEN 'backdated_createdAt' END AS reason FROM claim) SELECT *, CASE WHEN reason IS NULL THEN created_at ELSE indexed_at END AS published_at FROM r")
register("created_at_suspect", lambda t: c.resolve_published_at(claims(t)).groupBy("reason").agg(F.count(F.lit(1)).alias("posts")), f"WITH {_CLAIM} SELECT CASE WHEN created_at > indexed_at + INTERVAL 1 HOUR THEN 'future_createdAt' WHEN created_at < indexed_at - INTERVAL 2 DAY THEN 'backdated_createdAt' END AS reason, count(*) AS posts FROM claim GROUP BY 1")
register("resolve_lang", lambda t: t.posts.select("post_id", F.coalesce("lang", F.lit("(unknown)")).alias("lang")), "SELECT post_id, coalesce(lang, '(unknown)') AS lang FROM posts")
# two posts of a source share each id; a first load up to a time, then a batch that overlaps it by a day
_TWICE = lambda t: t.posts.select("source_key", F.expr("'q' || CAST(post_id - post_id % 6 + post_id % 3 AS STRING)").alias("source_post_id"), "post_id", "published_at")
_TWICE_SQL = "tw AS (SELECT source_key, 'q' || (post_id - post_id % 6 + post_id % 3) AS source_post_id, post_id, published_at FROM posts)"
_LOADED = "published_at < TIMESTAMP '2024-01-15 00:00:00'"
_ARRIVED = "published_at >= TIMESTAMP '2024-01-14 00:00:00'"
register("dedup_batch", lambda t: c.dedup_batch(_TWICE(t).drop("published_at"), ["source_key", "source_post_id"], "post_id"), f"WITH {_TWICE_SQL} SELECT source_key, source_post_id, min(post_id) AS post_id FROM tw GROUP BY ALL")
_NEW_SQL = f"""{_TWICE_SQL}, fresh AS (SELECT source_key, source_post_id, min(post_id) AS post_id FROM tw a WHERE {_ARRIVED}
      AND NOT EXISTS (SELECT 1 FROM tw b WHERE b.{_LOADED} AND b.source_key = a.source_key AND b.source_post_id = a.source_post_id) GROUP BY 1, 2)"""


def upserted(t):
    both = _TWICE(t)
    batch = both.where(_ARRIVED).drop("published_at")
    return c.upsert_posts(both.where(_LOADED), batch, ["source_key", "source_post_id"], "post_id"), batch


register("upsert_posts", lambda t: upserted(t)[0], f"WITH {_NEW_SQL} SELECT * FROM fresh")
register("upsert_counts", lambda t: c.upsert_counts(*upserted(t)), f"WITH {_NEW_SQL} SELECT (SELECT count(*) FROM fresh) AS inserted, count(*) - (SELECT count(*) FROM fresh) AS duplicates FROM tw WHERE {_ARRIVED}")
register("upsert_labels", lambda t: c.upsert_labels(t.labels.where("label_version = 'v1'").select("post_id", "label_version", "topic_key"), t.labels.where("label_version = 'v2' and post_id % 3 = 0").select("post_id", F.lit("v1").alias("label_version"), "topic_key")), "SELECT a.post_id, 'v1' AS label_version, CASE WHEN a.post_id % 3 = 0 THEN b.topic_key ELSE a.topic_key END AS topic_key FROM labels a JOIN labels b ON a.post_id = b.post_id AND a.label_version = 'v1' AND b.label_version = 'v2'")
register("label_counts", lambda t: c.label_counts(t.labels), "SELECT label_version, count(*) AS n, count(*) FILTER (is_relevant) AS n_relevant, count(*) FILTER (low_info) AS n_low_info FROM labels GROUP BY 1")
_TOKENS = r"""len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, 'https?://[^\s<>"'']+', ' ', 'g'), '@\w+', ' ', 'g'), '[^A-Za-z0-9]+'), lambda w: w <> ''))"""
register("effective_tokens", lambda t: t.posts.select("post_id", F.size(c.effective_tokens(F.col("text"))).alias("tokens")), f"SELECT post_id, CAST({_TOKENS} AS INTEGER) AS tokens FROM posts")


# vulnerabilities
_CV = r"cv AS (SELECT post_id, text, unnest(list_distinct(list_transform(regexp_extract_all(text, '(?i)\bCVE-\d{4}-\d{4,7}\b'), lambda x: upper(x)))) AS cve_id FROM posts), mention AS (SELECT post_id, cve_id, CAST(instr(upper(text), cve_id) - 1 AS BIGINT) AS char_start FROM cv)"
register("extract_cves", lambda t: c.extract_cves(t.posts), f"WITH {_CV} SELECT * FROM mention")
register("link_corpus", lambda t: c.link_corpus(t.posts, c.extract_cves(t.posts.where(_LOADED))).agg(F.countDistinct("post_id").alias("posts"), F.count(F.lit(1)).alias("links"), F.countDistinct("cve_id").alias("cves")), f"WITH {_CV} SELECT count(DISTINCT post_id) AS posts, count(*) AS links, count(DISTINCT cve_id) AS cves FROM mention JOIN posts p USING (post_id) WHERE NOT p.{_LOADED}")


def kev_list(t):
    """Every third part names an id; about half of these are records."""
    return t.given("part").where("p_partkey % 3 = 0").select(F.concat(F.lit("CVE-2024-"), (1000 + 2 * F.col("p_partkey")).cast("string")).alias("cve_id"), F.lit("2024-01-05").cast("date").alias("kev_date"))


register(
    "merge_kev", lambda t: c.merge_kev(t.cve_records, kev_list(t)),
    """WITH kv AS (SELECT 'CVE-2024-' || (1000 + 2 * p_partkey) AS cve_id, DATE '2024-01-05' AS kev_date FROM part WHERE p_partkey % 3 = 0)
      SELECT coalesce(r.cve_id, k.cve_id) AS cve_id, cvss, CASE WHEN k.cve_id IS NOT NULL THEN true ELSE known_exploited END AS known_exploited, kev_date FROM cve_records r FULL JOIN kv k ON r.cve_id = k.cve_id""",
)
register(
    "enrich_queue", lambda t: c.enrich_queue(c.extract_cves(t.posts), t.relevant, t.cve_records, t.cve_records.where("cvss > 2")),
    f"""WITH {_CV}, g AS (SELECT cve_id, count(DISTINCT post_id) AS posts, bool_or(post_id IN (SELECT post_id FROM relevant)) AS in_relevant FROM mention GROUP BY 1),
      k AS (SELECT g.*, coalesce(known_exploited, false) AS kev FROM g LEFT JOIN cve_records USING (cve_id))
      SELECT *, CASE WHEN in_relevant AND kev THEN 1 WHEN in_relevant THEN 2 WHEN kev THEN 3 ELSE 4 END AS tier FROM k
      WHERE (in_relevant OR kev OR posts >= 2) AND cve_id NOT IN (SELECT cve_id FROM cve_records WHERE cvss > 2)""",
)
register("top_cves", lambda t: c.top_cves(c.extract_cves(t.relevant), t.posts.where(in_window(F.col("published_at"), AS_OF, 7)), t.cve_records, 20), f"WITH {_CV}, g AS (SELECT cve_id, count(DISTINCT post_id) AS posts, count(DISTINCT source_key) AS sources, max(published_at) AS last_seen FROM mention JOIN relevant USING (post_id) WHERE {_CUR} GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY posts DESC, cve_id) AS place FROM g) SELECT o.*, cvss, known_exploited FROM o LEFT JOIN cve_records USING (cve_id) WHERE place <= 20")
register("cve_mentions_top4", lambda t: top(c.extract_cves(t.posts).join(t.posts.select("post_id", "published_at"), "post_id").join(t.labels.where("label_version = 'v1'").select("post_id", "is_relevant"), "post_id").select("cve_id", "post_id", "is_relevant", "published_at"), 4, F.desc("is_relevant"), F.desc("published_at"), "post_id", by=("cve_id",)), f"WITH {_CV}, j AS (SELECT cve_id, p.post_id, is_relevant, published_at FROM mention m JOIN posts p USING (post_id) JOIN labels l ON l.post_id = p.post_id AND label_version = 'v1') SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY is_relevant DESC, published_at DESC, post_id) AS place FROM j) WHERE place <= 4")
register("cve_totals", lambda t: c.extract_cves(t.relevant).agg(F.countDistinct("cve_id").alias("cves"), F.countDistinct("post_id").alias("posts"), F.count(F.lit(1)).alias("mentions")), f"WITH {_CV} SELECT count(DISTINCT cve_id) AS cves, count(DISTINCT post_id) AS posts, count(*) AS mentions FROM mention JOIN relevant USING (post_id)")
register("lookup_cve", lambda t: t.cve_records.join(c.extract_cves(t.posts).groupBy("cve_id").agg(F.count(F.lit(1)).alias("mentions")), "cve_id", "left").select("cve_id", "cvss", "known_exploited", F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions")), f"WITH {_CV} SELECT cve_id, cvss, known_exploited, count(post_id) AS mentions FROM cve_records LEFT JOIN mention USING (cve_id) GROUP BY ALL")
register(
    "cve_posts", lambda t: top(c.extract_cves(t.posts).select("cve_id", "post_id").join(t.posts.select("post_id", "published_at", "author_id"), "post_id"), 25, F.desc("published_at"), "post_id", by=("cve_id",)),
    f"WITH {_CV} SELECT * FROM (SELECT cve_id, post_id, published_at, author_id, row_number() OVER (PARTITION BY cve_id ORDER BY published_at DESC, post_id) AS place FROM mention JOIN posts USING (post_id)) WHERE place <= 25",
)
register("related_cves", lambda t: c.extract_cves(t.relevant).join(t.relevant.select("post_id", "topic"), "post_id").groupBy("topic", "cve_id").agg(F.count(F.lit(1)).alias("posts")), f"WITH {_CV} SELECT topic, cve_id, count(*) AS posts FROM mention JOIN relevant USING (post_id) GROUP BY 1, 2")
register("kev_concentration", lambda t: c.extract_cves(t.posts).join(t.cve_records, "cve_id", "left").agg(F.round(F.countDistinct(F.when(F.col("known_exploited"), F.col("cve_id"))) / F.countDistinct("cve_id"), 6).alias("of_cves"), F.round(F.count_if("known_exploited") / F.count(F.lit(1)), 6).alias("of_mentions")), f"WITH {_CV} SELECT round(count(DISTINCT cve_id) FILTER (known_exploited) / count(DISTINCT cve_id), 6) AS of_cves, round(count(*) FILTER (known_exploited) / count(*), 6) AS of_mentions FROM mention LEFT JOIN cve_records USING (cve_id)")

register(
    "kev_top", lambda t: c.kev_top(c.extract_cves(t.posts), t.cve_records, 20),
    f"""WITH {_CV}, g AS (SELECT cve_id, count(*) AS mentions FROM mention GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY mentions DESC, cve_id) AS place FROM g)
      SELECT o.*, coalesce(known_exploited, false) AS known_exploited FROM o LEFT JOIN cve_records USING (cve_id) WHERE place <= 20""",
)
register(
    "cve_daily_vector", lambda t: c.cve_daily_vector(c.extract_cves(t.posts), t.posts, AS_OF, 7),
    f"""WITH {_CV}, m AS (SELECT cve_id, CAST(published_at AS DATE) AS day FROM mention JOIN posts USING (post_id)), dd AS (SELECT unnest(generate_series(1, 7)) AS back),
      g AS (SELECT cve_id, count(*) FILTER (day >= DATE '{AS_OF[:10]}' - 14 AND day < DATE '{AS_OF[:10]}' - 7) AS before FROM m GROUP BY 1), n AS (SELECT cve_id, day, count(*) AS n FROM m GROUP BY 1, 2)
      SELECT g.cve_id, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY back DESC) AS daily, any_value(before) AS before
      FROM g CROSS JOIN dd LEFT JOIN n ON n.cve_id = g.cve_id AND n.day = DATE '{AS_OF[:10]}' - CAST(back AS INTEGER) GROUP BY 1""",
)

# registry
_EV = "ev AS (SELECT DISTINCT event_id, name, country, coalesce(published_at, discovered_at) AS at FROM registry WHERE CAST(coalesce(published_at, discovered_at) AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-25'), en AS (SELECT event_id, country, name AS entity, false AS is_domain, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS canonical FROM registry UNION ALL SELECT event_id, country, website, true, regexp_replace(regexp_replace(regexp_replace(lower(website), '^[a-z]+://', ''), '/.*$', ''), '^www\\.', '') FROM registry)"
_US = f"{_EV}, us AS (SELECT e.* FROM en e WHERE ((NOT is_domain AND length(canonical) >= 8 AND contains(canonical, ' ')) OR (is_domain AND length(canonical) >= 7)) AND (country = 'CA' OR canonical NOT IN (SELECT canonical FROM en WHERE country = 'CA')))"


def entities(t):
    return c.usable_entity(c.event_entities(t.registry), "CA")


def events(t):
    return c.ingest_events(t.registry, "2024-01-01", "2024-01-25")


register("ingest_events", events, f"WITH {_EV} SELECT * FROM ev")
register("canonical_name", lambda t: c.event_entities(t.registry), f"WITH {_EV} SELECT * FROM en")
register("event_entities", lambda t: c.event_entities(t.registry).groupBy("event_id").agg(F.count(F.lit(1)).alias("entities")), f"WITH {_EV} SELECT event_id, count(*) AS entities FROM en GROUP BY 1")
register("usable_entity", entities, f"WITH {_US} SELECT * FROM us")
register("events_with_domain", lambda t: c.event_entities(t.registry).where("is_domain").groupBy("event_id").agg(F.array_join(F.sort_array(F.collect_set("canonical")), ",").alias("domains")).withColumn("registry", F.split("event_id", ":")[0]), f"WITH {_EV} SELECT event_id, string_agg(DISTINCT canonical, ',' ORDER BY canonical) AS domains, split_part(event_id, ':', 1) AS registry FROM en WHERE is_domain GROUP BY 1")
