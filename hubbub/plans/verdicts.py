"""Model answers and entities over the adapted verdicts and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubbub.operators import verdicts as v
from hubbub.plans.catalog import register
from hubbub.plans.quality_checks import version

TOPICS = ["view", "click", "purchase", "error", "other"]
SUFFIX = ".org"

_PV = """pv AS (SELECT post_id, CASE WHEN json_valid(answer) THEN json_extract_string(answer, '$.topic') ELSE nullif(regexp_extract(answer, '"topic"\\s*:\\s*"([^"]*)"', 1), '') END AS said_topic,
      CASE WHEN json_valid(answer) THEN json_extract_string(answer, '$.confidence') ELSE nullif(regexp_extract(answer, '"confidence"\\s*:\\s*"([^"]*)"', 1), '') END AS said,
      CASE WHEN json_valid(answer) THEN json_extract_string(answer, '$.rationale') END AS r, CASE WHEN json_valid(answer) THEN json_extract_string(answer, '$.off_topic') = 'true' END AS o FROM verdicts),
      vd AS (SELECT post_id, CASE WHEN said_topic IN ('view', 'click', 'purchase', 'error', 'other') THEN said_topic END AS topic, CASE WHEN said IN ('high', 'medium', 'low') THEN said ELSE 'low' END AS confidence, coalesce(r, '') AS rationale, coalesce(o, false) AS off_topic,
      CASE WHEN said_topic IS NULL THEN 'no_topic' WHEN said_topic NOT IN ('view', 'click', 'purchase', 'error', 'other') THEN 'unknown_topic' END AS error FROM pv)"""
_CH = "ch AS (SELECT e.*, CASE WHEN NOT (contains(text, entity) OR contains(lower(text), lower(entity))) THEN 'not_in_text' WHEN kind = 'domain' AND NOT ends_with(lower(entity), '.org') THEN 'wrong_suffix' END AS fault FROM entities e JOIN posts USING (post_id))"


def checked(t):
    return v.validate_entities(t.entities, t.posts, SUFFIX)


def valid(t):
    return checked(t).where("fault is null")


register("parse_verdict", lambda t: v.parse_verdict(t.verdicts, TOPICS), f"WITH {_PV} SELECT * FROM vd")
register("topic_relabel", lambda t: v.topic_relabel(version(t, "v1"), v.parse_verdict(t.verdicts, TOPICS), "m1"), f"""WITH {_PV} SELECT post_id, 'm1' AS label_version, is_cyber, is_canada, is_relevant, nullif(topic, 'other') AS topic_key,
      CAST(CASE confidence WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 ELSE 0.3 END AS DOUBLE) AS confidence, off_topic FROM labels JOIN vd USING (post_id) WHERE label_version = 'v1' AND error IS NULL""")
register("validate_entities", checked, f"WITH {_CH} SELECT * FROM ch")
register("post_entities", lambda t: v.post_entities(t.entities, t.posts), """SELECT post_id, label_version, entity, min(kind) AS kind, CAST(min(CASE WHEN instr(text, entity) > 0 THEN instr(text, entity) ELSE instr(lower(text), lower(entity)) END - 1) AS INTEGER) AS offset, lower(entity) AS canonical
      FROM entities JOIN posts USING (post_id) GROUP BY post_id, label_version, entity""")
register("tri_state_gate", lambda t: v.tri_state_gate(t.posts, valid(t), version(t, "v2")), f"""WITH {_CH}, h AS (SELECT DISTINCT post_id FROM ch WHERE fault IS NULL)
      SELECT p.post_id, is_cyber, h.post_id IS NOT NULL AS is_canada, h.post_id IS NOT NULL AND coalesce(is_cyber, false) AS is_relevant FROM posts p LEFT JOIN h USING (post_id) LEFT JOIN labels l ON l.post_id = p.post_id AND label_version = 'v2'""")
register("screen_candidates", lambda t: v.screen_candidates(t.posts, version(t, "v1")), "SELECT post_id, CAST(length(text) AS INTEGER) AS n FROM posts JOIN labels USING (post_id) WHERE label_version = 'v1' AND NOT is_canada AND length(text) > 40")
register("entity_trend", lambda t: v.entity_trend(valid(t), t.relevant), f"""WITH {_CH}, d AS (SELECT DISTINCT post_id, lower(entity) AS entity FROM ch WHERE fault IS NULL)
      , r AS (SELECT d.*, author_id, topic FROM d JOIN relevant USING (post_id)), pr AS (SELECT a.entity, b.entity AS other, count(*) AS n FROM r a JOIN r b ON a.post_id = b.post_id AND a.entity <> b.entity GROUP BY 1, 2),
      o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, other) AS place FROM pr), m AS (SELECT entity, string_agg(other, ',' ORDER BY place) AS co_entities FROM o WHERE place <= 5 GROUP BY 1),
      g AS (SELECT entity, count(*) AS mentions, count(DISTINCT author_id) AS authors, list_sort(list_distinct(list(topic))) AS topics FROM r GROUP BY 1) SELECT g.*, co_entities FROM g LEFT JOIN m USING (entity)""")
register("topic_entities", lambda t: v.topic_entities(valid(t), t.relevant).orderBy(F.desc("posts"), "topic", "kind", "entity").limit(20), f"""WITH {_CH}, d AS (SELECT DISTINCT post_id, kind, lower(entity) AS entity FROM ch WHERE fault IS NULL)
      SELECT topic, kind, entity, count(*) AS posts FROM d JOIN relevant USING (post_id) GROUP BY 1, 2, 3 ORDER BY posts DESC, topic, kind, entity LIMIT 20""")
