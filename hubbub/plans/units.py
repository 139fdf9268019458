"""Coded units, populations and record bodies, made from the adapted tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubbub.operators import units as u
from hubbub.plans.catalog import register
from hubbub.plans.quality_checks import version
from hubbub.plans.verdicts import _CH, checked

_UNITS = [
    "event_id AS unit_id",
    "CASE user_id % 5 WHEN 0 THEN 'automated_feed' WHEN 1 THEN 'news_media' WHEN 2 THEN 'organizational_broadcast' WHEN 3 THEN 'security_professional' ELSE 'individual_participant' END AS role",
    "CASE event_id % 6 WHEN 0 THEN 'broadcast_or_repost' WHEN 1 THEN 'substantive_reply' WHEN 2 THEN 'information_seeking' WHEN 3 THEN 'information_providing' WHEN 4 THEN 'discussion_or_reaction' ELSE 'unclear' END AS function",
]
_SIGNAL = f"""un AS (SELECT {', '.join(_UNITS)} FROM base), si AS (SELECT *, CASE WHEN role = 'automated_feed' OR function = 'broadcast_or_repost' THEN 0 WHEN function <> 'unclear' THEN 1 END AS signal FROM un),
      ps AS (SELECT *, CASE WHEN signal = 1 AND role IN ('news_media', 'organizational_broadcast') THEN NULL ELSE signal END AS person_signal FROM si)"""
register("human_signal", lambda t: u.human_signal(t.base.selectExpr(*_UNITS)), f"WITH {_SIGNAL} SELECT * FROM ps")
register("human_signal_shares", lambda t: u.signal_summary(u.human_signal(t.base.selectExpr(*_UNITS)), "role"), f"""WITH {_SIGNAL} SELECT role, count(*) AS units, count(*) FILTER (signal = 1) AS signal_1, count(*) FILTER (signal = 0) AS signal_0, round(avg(CAST(signal IS NULL AS INTEGER)), 6) AS signal_na_share,
      count(*) FILTER (person_signal = 1) AS person_signal_1, count(*) FILTER (person_signal = 0) AS person_signal_0, round(avg(CAST(person_signal IS NULL AS INTEGER)), 6) AS person_signal_na_share FROM ps GROUP BY 1""")


def bodies(t):
    """A record for each part, with some of the three versions."""
    score, group = (F.col("p_partkey") % 100).cast("double") / 10, F.col("p_partkey") % 4
    data = lambda more, *severity: F.struct((score + more).alias("baseScore"), *severity).alias("cvssData")
    level = lambda s: F.lit(s).alias("baseSeverity")
    metrics = F.struct(
        F.when(group < 1, F.array(F.struct(data(0, level("HIGH"))))).alias("cvssMetricV31"), F.when(group < 2, F.array(F.struct(data(100, level("LOW"))))).alias("cvssMetricV30"),
        F.when(group < 3, F.array(F.struct(data(200), level("MEDIUM")))).alias("cvssMetricV2"),
    )
    say = lambda lang, start: F.struct(F.lit(lang).alias("lang"), F.concat(F.lit(start), F.col("p_partkey").cast("string")).alias("value"))
    body = F.to_json(F.struct(metrics.alias("metrics"), F.array(say("fr", "pièce "), say("en", "part ")).alias("descriptions")))
    return t.part.select(F.concat(F.lit("CVE-2024-"), F.col("p_partkey").cast("string")).alias("cve_id"), body.alias("body"))


register("best_cvss", lambda t: u.best_cvss(bodies(t), "body"), """WITH g AS (SELECT p_partkey AS k, p_partkey % 4 AS g, CAST(p_partkey % 100 AS DOUBLE) / 10 AS s FROM part)
      SELECT 'CVE-2024-' || k AS cve_id, CASE g WHEN 0 THEN '3.1' WHEN 1 THEN '3.0' WHEN 2 THEN '2.0' END AS version, CASE g WHEN 0 THEN s WHEN 1 THEN s + 100 WHEN 2 THEN s + 200 END AS score,
      CASE g WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' END AS severity, 'part ' || k AS description FROM g""")


def populations(t):
    """The checked version is the main one, the second version before its check the legacy one, the first that of the rules."""
    found = checked(t)
    some = lambda rows: rows.select("post_id").distinct().withColumn("some", F.lit(True))
    cyber = F.coalesce("is_cyber", F.lit(False)) & F.col("some").isNotNull()
    judged = version(t, "v2")
    legacy = judged.join(some(found), "post_id", "left").select("post_id", cyber.alias("is_relevant"))
    main = judged.join(some(found.where("fault is null")), "post_id", "left")
    main = main.select("post_id", cyber.alias("is_relevant"), F.concat(F.split("derived_chain", ">"), F.array(F.lit("v2"))).alias("derived_chain"), F.lit("v2_checked").alias("step"))
    heads = judged.where("post_id % 4 < 3").select(
        "post_id", F.split("derived_chain", ">")[0].alias("label_version"), F.sha2((F.col("post_id") % 3).cast("string"), 256).alias("prompt_sha256"), F.concat(F.lit("m"), F.col("post_id") % 2).alias("model_id"),
        F.expr("TIMESTAMP '2024-01-02 03:04:05'").alias("recorded_at"),
    )
    return u.seed_populations(main, legacy, version(t, "v1").select("post_id", "is_relevant"), found, heads)


_POPULATIONS = f"""{_CH}, sm AS (SELECT post_id, bool_or(fault IS NULL) AS good, string_agg(DISTINCT fault, '+' ORDER BY fault) AS why FROM ch GROUP BY 1),
      po AS (SELECT v.post_id AS seed_id, coalesce(v.is_cyber, false) AND coalesce(good, false) AS in_main, coalesce(v.is_cyber, false) AND sm.post_id IS NOT NULL AS in_legacy, r.is_relevant AS in_rules,
        v.derived_chain || '>v2>v2_checked' AS derived_chain, split_part(v.derived_chain, '>', 1) AS head, why
        FROM labels v JOIN labels r ON r.post_id = v.post_id AND r.label_version = 'v1' LEFT JOIN sm ON sm.post_id = v.post_id WHERE v.label_version = 'v2')"""
register(
    "seed_populations", populations,
    f"""WITH {_POPULATIONS} SELECT seed_id, in_main, in_legacy, in_rules, derived_chain, CASE WHEN in_main OR in_legacy THEN 'derived_validated' ELSE 'deterministic_rules' END AS provenance_status,
      CASE WHEN in_main OR in_legacy THEN CASE WHEN seed_id % 4 < 3 THEN head || '@2024-01-02 03:04:05' ELSE '' END END AS annotation_run,
      CASE WHEN (in_main OR in_legacy) AND seed_id % 4 < 3 THEN sha256(CAST(seed_id % 3 AS VARCHAR)) END AS prompt_hash, CASE WHEN (in_main OR in_legacy) AND seed_id % 4 < 3 THEN 'm' || (seed_id % 2) END AS model,
      CASE WHEN in_legacy AND NOT in_main THEN 'failed_check:' || coalesce(why, '') END AS exclusion_reason FROM po WHERE in_legacy OR in_rules""",
)
register("population_overlaps", lambda t: u.population_overlaps(populations(t)), f"WITH {_POPULATIONS} SELECT in_main, in_legacy, in_rules, count(*) AS seeds FROM po WHERE in_legacy OR in_rules GROUP BY 1, 2, 3")
