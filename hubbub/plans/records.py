"""Portal matching, visibility, funnel, stored analyses, manifests, coding rounds and units over the adapted tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubbub.operators import events as ev
from hubbub.operators import records, trend
from hubbub.plans import graph, signals
from hubbub.plans.adapters import AS_OF
from hubbub.plans.catalog import register
from hubbub.sources.staging import staging_path


def home_events(t):
    return t.registry.where("country = 'CA'").select("event_id", F.col("published_at").alias("at"), "name", "website")


def portal_entities(t):
    kinds = F.array(F.struct(F.col("name").alias("entity"), F.lit("org").alias("kind")), F.struct(F.col("website").alias("entity"), F.lit("domain").alias("kind")))
    return home_events(t).select("event_id", "at", F.explode(kinds).alias("e")).select("event_id", "at", "e.*")


def matches(t):
    return ev.match_portal(t.posts, portal_entities(t))


_PM = """pe AS (SELECT event_id, published_at AS moment, lower(unnest([name, website])) AS entity, unnest(['org', 'domain']) AS kind FROM registry WHERE country = 'CA' AND published_at IS NOT NULL),
    pm AS (SELECT event_id, post_id, min(kind) AS matched_on FROM posts JOIN pe ON published_at >= moment - INTERVAL 14 DAY AND published_at <= moment + INTERVAL 30 DAY AND contains(lower(text), entity)
      WHERE length(entity) >= 6 GROUP BY 1, 2)"""
register("event_match_portal", matches, f"WITH {_PM} SELECT * FROM pm")
register("event_visibility", lambda t: ev.visibility(home_events(t), matches(t), t.posts, t.edges), f"""WITH {_PM}, o AS (SELECT event_id, count(*) AS posts, count(DISTINCT author_id) AS actors FROM pm JOIN posts USING (post_id) GROUP BY 1),
      m AS (SELECT event_id, count(*) FILTER (edge_type = 'reply') AS replies, count(*) FILTER (edge_type = 'quote') AS quotes, count(DISTINCT actor) FILTER (edge_type = 'repost') AS reposters
        FROM pm JOIN edges ON target_id = post_id GROUP BY 1)
      SELECT event_id, coalesce(posts, 0) AS posts, coalesce(actors, 0) AS actors, coalesce(replies, 0) AS replies, coalesce(quotes, 0) AS quotes, coalesce(reposters, 0) AS reposters, coalesce(posts, 0) > 0 AS visible
      FROM (SELECT DISTINCT event_id FROM registry WHERE country = 'CA') LEFT JOIN o USING (event_id) LEFT JOIN m USING (event_id)""")


def full_funnel(t):
    """Seeds are the relevant posts; a first-level reply by an account that is no broadcast stands for validated discussion."""
    loud = signals.broadcast(t)
    human = t.edges.where("edge_type = 'reply' and depth = 1").join(loud.select(F.col("author_id").alias("actor")), "actor", "left_anti")
    return ev.funnel(home_events(t), matches(t), t.posts, t.relevant, loud, t.edges, human)


register("event_funnel_full", full_funnel, f"""WITH {signals.ACTIVITY_SQL}, {_PM},
      tk AS (SELECT target_id AS post_id, bool_or(edge_type = 'reply' AND depth = 1 AND actor NOT IN (SELECT author_id FROM bc)) AS human FROM edges WHERE edge_type IN ('reply', 'quote') GROUP BY 1),
      f AS (SELECT event_id, r.post_id IS NOT NULL AS seed, r.post_id IS NOT NULL AND p.author_id NOT IN (SELECT author_id FROM bc) AS organic, tk.post_id IS NOT NULL AS talk, coalesce(human, false) AS human
        FROM pm JOIN posts p USING (post_id) LEFT JOIN (SELECT DISTINCT post_id FROM relevant) r ON r.post_id = p.post_id LEFT JOIN tk ON tk.post_id = p.post_id),
      b AS (SELECT event_id, max(CASE WHEN organic AND human THEN 6 WHEN organic AND talk THEN 5 WHEN organic THEN 4 WHEN seed THEN 3 ELSE 2 END) AS reached FROM f GROUP BY 1),
      e AS (SELECT event_id, coalesce(reached, 1) AS reached FROM (SELECT DISTINCT event_id FROM registry WHERE country = 'CA') LEFT JOIN b USING (event_id))
      SELECT CAST(step AS INTEGER) AS step, name, count(*) FILTER (reached >= step) AS events FROM e, (SELECT unnest(range(1, 7)) AS step, unnest(['events', 'trace', 'captured', 'organic', 'interaction', 'discussion']) AS name) GROUP BY 1, 2""")


def stored_analysis(t):
    """Two analyses are appended, one a week earlier; the rows come from the file."""
    path = staging_path(t.spark, "analyses")
    for as_of in (AS_OF, "2024-01-22 00:00:00"):
        compared = trend.trend_compare(t.relevant, as_of, 7).select("topic", "n_cur", "n_prev", "abs_delta")
        records.persist_analysis(compared, ["topic"], as_of, {"days": 7}, path)
    return records.read_analysis(t.spark, path, "place int, topic string, n_cur long, n_prev long, abs_delta long")


_WEEK = """SELECT '{0}' AS as_of, '{{"days": 7}}' AS params, CAST(row_number() OVER (ORDER BY topic) AS INTEGER) AS place, topic, n_cur, n_prev, n_cur - n_prev AS abs_delta FROM
      (SELECT topic, count(*) FILTER (published_at >= TIMESTAMP '{0}' - INTERVAL 7 DAY) AS n_cur, count(*) FILTER (published_at < TIMESTAMP '{0}' - INTERVAL 7 DAY) AS n_prev FROM relevant
       WHERE published_at >= TIMESTAMP '{0}' - INTERVAL 14 DAY AND published_at < TIMESTAMP '{0}' GROUP BY 1)"""
register("persist_analysis", stored_analysis, f"SELECT * FROM ({_WEEK.format(AS_OF)}) UNION ALL SELECT * FROM ({_WEEK.format('2024-01-22 00:00:00')})")


def frozen_seeds(t):
    path = staging_path(t.spark, "manifest")
    rows = t.seeds.select("seed_id", F.concat(F.lit("at://p/"), F.col("seed_id").cast("string")).alias("uri"), "author_id", "topic_key", "in_main", "in_legacy")
    records.freeze_manifest(rows, path, "uri", ["in_main", "in_legacy"])
    return records.load_manifest(t.spark, path, rows.schema.simpleString()[7:-1].replace(":", " "), "uri", ["in_main", "in_legacy"])


register("seed_manifest", frozen_seeds, "SELECT seed_id, 'at://p/' || seed_id AS uri, author_id, topic_key, in_main, in_legacy FROM seeds")
register("page_size_diff", lambda t: records.page_size_diff(t.edges, 0, 2), """WITH k AS (SELECT edge_type, seed_id, actor, bool_or(run_id = 0) AS x, bool_or(run_id = 2) AS y FROM edges
      WHERE edge_type IN ('quote', 'repost') AND run_id IN (0, 2) AND seed_id IN (SELECT seed_id FROM edges WHERE run_id = 2) GROUP BY 1, 2, 3)
      SELECT edge_type, count(*) FILTER (x) AS keys_a, count(*) FILTER (y) AS keys_b, count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (y AND NOT x) AS only_b FROM k GROUP BY 1""")


def embedded(t):
    """Every fourth post embeds an earlier one; half of those within another record."""
    uri = F.concat(F.lit("at://p/"), (F.col("post_id") - F.col("k") % 9 - 1).cast("string"))
    record = F.when(F.col("post_id") % 8 == 0, F.struct(uri.alias("uri"), F.lit(None).cast("struct<uri: string>").alias("record")))
    record = record.otherwise(F.struct(F.lit(None).cast("string").alias("uri"), F.struct(uri.alias("uri")).alias("record")))
    return t.posts.withColumn("raw", F.when(F.col("post_id") % 4 == 0, F.to_json(F.struct(F.struct(record.alias("record")).alias("embed")))))


register("corpus_quote_edges", lambda t: records.corpus_quote_edges(embedded(t), "raw"), "SELECT a.post_id AS quoting, b.post_id AS quoted FROM posts a JOIN posts b ON b.uri = 'at://p/' || (a.post_id - a.k % 9 - 1) WHERE a.post_id % 4 = 0")


def coded(t):
    code = F.expr("CASE event_id % 6 WHEN 0 THEN 'MISS_' || event_type WHEN 1 THEN 'NEW_thing' WHEN 2 THEN 'FP' ELSE 'GENERIC' END")
    gold = t.events.select(F.col("event_id").alias("post_id"), code.alias("code"))
    labels = t.labels.where("label_version = 'v2'").select("post_id", F.coalesce("topic_key", F.lit("other")).alias("topic"), (F.col("post_id") % 9 == 2).alias("off_topic"))
    return records.topic_coding_eval(gold, labels)


register("topic_coding_eval", coded, """WITH g AS (SELECT event_id AS post_id, CASE event_id % 6 WHEN 0 THEN 'MISS_' || event_type WHEN 1 THEN 'NEW_thing' WHEN 2 THEN 'FP' ELSE 'GENERIC' END AS code FROM events),
      r AS (SELECT code, coalesce(topic_key, 'other') AS topic, post_id % 9 = 2 AS off_topic FROM g JOIN labels USING (post_id) WHERE label_version = 'v2'),
      c AS (SELECT count(*) FILTER (code LIKE 'MISS%') AS missed, count(*) FILTER (code LIKE 'MISS%' AND topic = substr(code, 6)) AS hit, count(*) FILTER (code LIKE 'MISS%' AND topic = 'other') AS left_other,
        count(*) FILTER (code LIKE 'NEW%') AS new, count(*) FILTER (code LIKE 'NEW%' AND topic = 'other') AS kept, count(*) FILTER (code = 'FP') AS fp, count(*) FILTER (code = 'FP' AND off_topic) AS flagged,
        count(*) FILTER (code <> 'FP') AS others, count(*) FILTER (code <> 'FP' AND off_topic) AS alarms FROM r)
      SELECT *, round(hit / missed, 6) AS recall, round(kept / new, 6) AS restraint, round(flagged / fp, 6) AS flag_recall, round(alarms / others, 6) AS alarm_rate,
        round(2 * (hit / missed) * (kept / new) / (hit / missed + kept / new), 6) AS harmonic_mean FROM c""")
register("annotation_units", lambda t: records.annotation_units(graph.facts(t).where("observed"), graph.adopted(t), t.posts), f"""WITH {graph._FA}, o AS (SELECT * FROM fa WHERE observed),
      q AS (SELECT quantile_cont(d1 + quotes, 0.5) AS middle FROM o),
      u AS (SELECT seed_id AS unit, 'seed' AS kind, 0 AS nth, seed_id, CAST(NULL AS BIGINT) AS parent FROM o
        UNION ALL SELECT edge_no, CASE WHEN edge_type = 'quote' THEN 'quote' WHEN depth = 1 THEN 'reply_1' ELSE 'reply_2' END, CASE WHEN edge_type = 'quote' THEN 3 WHEN depth = 1 THEN 1 ELSE 2 END, seed_id, target_id
        FROM ae WHERE edge_type IN ('reply', 'quote') AND seed_id IN (SELECT seed_id FROM o)),
      f AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY nth, seed_id, kind, parent) AS place FROM u)
      SELECT unit, kind, seed_id, p.text, c.text AS context, CASE WHEN d1 + quotes >= middle THEN 'high' ELSE 'low' END AS stratum
      FROM f JOIN o USING (seed_id) JOIN posts p ON p.post_id = unit LEFT JOIN posts c ON c.post_id = parent, q WHERE place = 1""")
