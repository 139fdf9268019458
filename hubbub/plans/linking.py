"""Registry events in posts: names and domains, evaluation sets, a second corpus, first posts, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubbub.operators import authors, linking
from hubbub.operators import content as c
from hubbub.plans.catalog import register
from hubbub.plans.content import entities, events

EVERYTHING = "2023-01-01", "2025-01-01"
HOME = "CA"


def feeds(t):
    return authors.author_strata(t.posts, min_posts=5).where("stratum = 'feed'")


def matches(t):
    return linking.name_matches(t.posts, entities(t).join(events(t).select("event_id", "at"), "event_id"), (linking.BEFORE, linking.AFTER))


def sets(t):
    """Home and foreign events at any distance."""
    dated = c.ingest_events(t.registry, *EVERYTHING).select("event_id", "at", "country")
    found = linking.name_matches(t.posts, entities(t).drop("country").join(dated, "event_id"))
    return linking.evaluation_sets(found, dated, t.posts, authors.author_strata(t.posts, min_posts=5), HOME)


def second_corpus(t):
    """The third source was not collected: its posts stand for a search beyond the corpus."""
    cyber = t.labels.where("label_version = 'v2' and is_relevant")
    return linking.second_corpus_hits(events(t), matches(t), t.posts, t.posts.where("source_key <> 's2'"), cyber, feeds(t))


def search(t):
    described = t.cve_records.join(t.given("part").select(F.expr("'CVE-2024-' || CAST(1000 + p_partkey AS STRING)").alias("cve_id"), F.col("p_name").alias("description")), "cve_id")
    dated = t.registry.select("event_id", "name", F.coalesce("published_at", "discovered_at").alias("at"))
    parts = [linking.search_registry(dated, c.event_entities(t.registry), described, q).withColumn("query", F.lit(q)) for q in (" Supplier1", "2024-10")]
    return parts[0].unionByName(parts[1])


_BARE = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def _sql(first: str, last: str) -> str:
    """xm: which post names which event by which entity, and how many days later."""
    return rf"""en AS (SELECT event_id, country, name AS entity, false AS is_domain, {_BARE.format('name')} AS canonical FROM registry
        UNION ALL SELECT event_id, country, website, true, regexp_replace(regexp_replace(regexp_replace(lower(website), '^[a-z]+://', ''), '/.*$', ''), '^www\.', '') FROM registry),
      ev AS (SELECT DISTINCT event_id, name, country, coalesce(published_at, discovered_at) AS moment FROM registry
             WHERE CAST(coalesce(published_at, discovered_at) AS DATE) BETWEEN DATE '{first}' AND DATE '{last}'),
      us AS (SELECT DISTINCT event_id, canonical, is_domain FROM en
             WHERE ((NOT is_domain AND length(canonical) >= 8 AND contains(canonical, ' ')) OR (is_domain AND length(canonical) >= 7))
               AND (country = '{HOME}' OR canonical NOT IN (SELECT canonical FROM en WHERE country = '{HOME}'
                    AND ((NOT is_domain AND length(canonical) >= 8 AND contains(canonical, ' ')) OR (is_domain AND length(canonical) >= 7))))),
      nm AS (SELECT DISTINCT canonical, is_domain FROM us),
      tx AS (SELECT post_id, published_at, lower(text) AS low, ' ' || {_BARE.format('text')} || ' ' AS bare FROM posts),
      th AS (SELECT post_id, published_at, canonical, is_domain FROM tx JOIN nm ON
             (NOT is_domain AND contains(bare, ' ' || canonical || ' ')) OR (is_domain AND contains(low, canonical)
              AND regexp_matches(low, '(^|[^a-z0-9_])' || regexp_escape(canonical) || '($|[^a-z0-9_])'))),
      xm AS (SELECT th.post_id, event_id, ev.country, canonical, is_domain, CAST(floor((epoch_us(published_at) - epoch_us(moment)) / 86400000000) AS BIGINT) AS delta, moment, published_at
             FROM th JOIN us USING (canonical, is_domain) JOIN ev USING (event_id)),
      st AS (SELECT author_id, CASE WHEN count(*) >= 5 AND round(avg(coalesce(like_count, 0) + coalesce(repost_count, 0)), 6) < 0.5 THEN 'feed' ELSE 'other' END AS stratum FROM posts GROUP BY 1)"""


_NEAR = f"{_sql('2024-01-01', '2024-01-25')}, xw AS (SELECT * FROM xm WHERE delta BETWEEN -2 AND 30)"
register("event_name_matches", matches, f"WITH {_NEAR} SELECT post_id, event_id, canonical, is_domain, delta FROM xw")
register(
    "event_match_eval", sets,
    f"""WITH {_sql(*EVERYTHING)}, g AS (SELECT post_id, bool_or(country = '{HOME}') AS own, bool_or(country = '{HOME}' AND delta BETWEEN -2 AND 30) AS near,
        arg_min(event_id, (abs(delta), event_id)) FILTER (country = '{HOME}' AND delta BETWEEN -2 AND 30) AS event_id,
        arg_min(delta, (abs(delta), event_id)) FILTER (country = '{HOME}' AND delta BETWEEN -2 AND 30) AS delta,
        list_sort(list_distinct(list(event_id) FILTER (country = '{HOME}'))) AS ids,
        list_sort(list_distinct(list(canonical) FILTER (country = '{HOME}'))) AS mine, list_sort(list_distinct(list(canonical))) AS every FROM xm GROUP BY 1)
      SELECT g.post_id, CASE WHEN near THEN 'positive' WHEN own THEN 'out_of_window' ELSE 'negative' END AS label, stratum, event_id, delta,
        CASE WHEN near THEN array_to_string(ids[1:5], ',') END AS event_ids, array_to_string(CASE WHEN own THEN mine ELSE every END, ',') AS entities
      FROM g JOIN posts USING (post_id) JOIN st USING (author_id)""",
)
register(
    "nearest_event", lambda t: c.nearest_event(matches(t)),
    f"WITH {_NEAR} SELECT post_id, arg_min(event_id, (abs(delta), event_id)) AS event_id, arg_min(delta, (abs(delta), event_id)) AS delta FROM xw GROUP BY 1",
)
_HITS = f"""{_NEAR}, hw AS (SELECT DISTINCT event_id, xw.post_id, source_key <> 's2' AS have, l.is_relevant AS on_subject, stratum = 'feed' AS feed
        FROM xw JOIN posts p USING (post_id) JOIN labels l ON l.post_id = p.post_id AND l.label_version = 'v2' JOIN st USING (author_id)),
      hc AS (SELECT ev.event_id, count(hw.post_id) AS hits, count(*) FILTER (have) AS in_corpus, count(*) FILTER (on_subject) AS cyber,
             count(*) FILTER (on_subject AND have) AS cyber_in_corpus, count(*) FILTER (on_subject AND NOT feed) AS cyber_organic FROM ev LEFT JOIN hw USING (event_id) GROUP BY 1)"""
register("oracle_hits", second_corpus, f"WITH {_HITS} SELECT * FROM hc")
register(
    "event_funnel", lambda t: linking.stages_of(second_corpus(t)),
    f"WITH {_HITS} SELECT count(*) AS listed, count(*) FILTER (cyber > 0) AS discussed, count(*) FILTER (cyber_in_corpus > 0) AS collected, count(*) FILTER (cyber_organic > 0) AS organic FROM hc",
)
register(
    "event_lead_lag", lambda t: linking.first_posts(matches(t), events(t), t.posts, feeds(t)),
    f"""WITH {_NEAR}, p AS (SELECT DISTINCT event_id, post_id, (epoch_us(xw.published_at) - epoch_us(moment)) / 3600000000 AS hours, stratum = 'feed' AS feed FROM xw JOIN posts USING (post_id) JOIN st USING (author_id)),
      q AS (SELECT event_id, count(*) AS posts, arg_min(post_id, (hours, post_id)) AS first_post, min(hours) AS h, min(hours) FILTER (feed) AS f, min(hours) FILTER (NOT feed) AS o,
            arg_min(feed, (hours, post_id)) AS by_feed FROM p GROUP BY 1)
      SELECT event_id, posts, first_post, round(h, 6) AS lead_hours, round(f, 6) AS feed_hours, round(o, 6) AS organic_hours, CASE WHEN by_feed THEN 'feed' ELSE 'organic' END AS first_by FROM q""",
)
_SEARCH = """SELECT '{0}' AS query, 'event' AS kind, event_id AS id, CAST(place AS INTEGER) AS place, name AS label FROM
        (SELECT event_id, name, row_number() OVER (ORDER BY coalesce(published_at, discovered_at) DESC NULLS LAST, event_id) AS place FROM registry r WHERE name ILIKE '%{1}%' OR website ILIKE '%{1}%') WHERE place <= 15
      UNION ALL SELECT '{0}', 'record', cve_id, CAST(place AS INTEGER), p_name FROM
        (SELECT cve_id, p_name, row_number() OVER (ORDER BY known_exploited DESC NULLS LAST, cvss DESC NULLS LAST, cve_id) AS place FROM cve_records JOIN part ON cve_id = 'CVE-2024-' || (1000 + p_partkey)
         WHERE p_name ILIKE '%{1}%' OR cve_id ILIKE '%{1}%') WHERE place <= 10"""
register("search_events", search, f"{_SEARCH.format(' Supplier1', 'Supplier1')} UNION ALL {_SEARCH.format('2024-10', '2024-10')}")
