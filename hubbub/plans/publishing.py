"""The portal's panels as one published version, and a derived label version."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubbub.operators import publishing as p
from hubbub.plans.catalog import ORACLES, QUERIES, register
from hubbub.plans.quality_checks import version
from hubbub.plans.verdicts import _CH, checked
from hubbub.sources.staging import staging_path

#: panel -> query.
PANELS = {"daily": "pilot_daily", "topics": "topic_daily", "posts": "recent_posts", "cves": "cve_daily_vector", "cve_mentions": "cve_mentions_top4", "events": "event_match_portal", "runs": "last_run_per_source"}


def snapshot(t):
    root = staging_path(t.spark, "portal")
    p.publish({panel: QUERIES[name](t.spark, t.sf_dir) for panel, name in PANELS.items()}, root, "2024-01-29")
    return p.current_manifest(t.spark, root).select("panel", "rows", "version")


def _panel_sql(panel: str, name: str) -> str:
    return f"SELECT '{panel}' AS panel, (SELECT count(*) FROM ({ORACLES[name]}) q) AS rows, '2024-01-29' AS version"


register("portal_snapshot", snapshot)
ORACLES["portal_snapshot"] = " UNION ALL ".join(_panel_sql(panel, name) for panel, name in PANELS.items())


def _source(t):
    own = t.entities.where("label_version = 'v2'").groupBy("post_id").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    rows = version(t, "v2").join(own, "post_id", "left")
    chain = F.filter(F.split("derived_chain", ">"), lambda c: c != "model")
    return rows.select("post_id", "is_cyber", "is_canada", "is_relevant", "topic_key", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), F.array().cast("array<string>").alias("dropped"), chain.alias("derived_chain"))


def _derived(t):
    path = staging_path(t.spark, "labels")
    p.write_version(_source(t), path, "v2")
    before = p.read_version(t.spark, path, "v2")
    p.write_version(p.derived_labels(before, checked(t), "v2"), path, "v2_checked")
    return before, p.read_version(t.spark, path, "v2_checked")


def revalidated(t):
    text = lambda c: F.array_join(c, ",").alias(c)
    return _derived(t)[1].select("post_id", "is_cyber", "is_canada", "is_relevant", text("entities"), text("dropped"), text("derived_chain"))


_RV = f"""{_CH}, g AS (SELECT post_id, list_sort(list_distinct(list(entity) FILTER (fault IS NULL))) AS good, list_sort(list_distinct(list(entity) FILTER (fault IS NOT NULL))) AS bad FROM ch GROUP BY 1),
    rv AS (SELECT l.post_id, is_cyber, len(coalesce(good, [])) > 0 AS is_canada, len(coalesce(good, [])) > 0 AND coalesce(is_cyber, false) AS is_relevant, array_to_string(coalesce(good, []), ',') AS entities,
      array_to_string(coalesce(bad, []), ',') AS dropped, CASE WHEN post_id % 2 = 0 THEN 'rules,v2' ELSE 'v2' END AS derived_chain, len(coalesce(bad, [])) AS n_bad, g.post_id IS NOT NULL AND coalesce(is_cyber, false) AS was
      FROM labels l LEFT JOIN g USING (post_id) WHERE label_version = 'v2')"""
register("revalidate_labels", revalidated, f"WITH {_RV} SELECT post_id, is_cyber, is_canada, is_relevant, entities, dropped, derived_chain FROM rv")
register(
    "revalidate_counts", lambda t: p.derivation_counts(*_derived(t)),
    f"WITH {_RV} SELECT count(*) AS posts, count(*) FILTER (is_relevant) AS relevant, CAST(sum(n_bad) AS BIGINT) AS dropped, count(*) FILTER (was AND NOT is_relevant) AS lost FROM rv",
)
