"""Conversation jobs over the adapted seeds and the edges of their adopted runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubbub.operators import conversations as c
from hubbub.operators import interaction
from hubbub.plans import graph
from hubbub.plans.catalog import register
from hubbub.sources.staging import staged

KEYS = ["topic_key", "actor_type", "actor_function", "has_cve"]
_FUNCTION = "CASE CAST(floor(seed_id / 20) AS BIGINT) % 3 WHEN 0 THEN 'research' WHEN 1 THEN 'press' END"
_REPORTED = {"quote_count": "seed_id % 7 % 3", "repost_count": "CASE WHEN seed_id % 13 > 0 THEN seed_id % 11 % 4 END"}


def facts(t):
    rows = graph.facts(t).withColumn("actor_function", F.expr(_FUNCTION))
    for name, how in _REPORTED.items():
        rows = rows.withColumn(name, F.expr(how))
    return rows


def main_facts(t):
    return facts(t).where("in_main")


def roles(t):
    return c.seed_roles(facts(t), graph.adopted(t))


def populations():
    return {name: F.expr(where) for name, where in _POPULATIONS.items()}


_POPULATIONS = {"all": "true", "main": "in_main", "legacy": "in_legacy", "legacy_only": "in_legacy AND NOT in_main", "with_cve": "has_cve"}

_FX = f"""{graph._FA}, fx AS (SELECT *, {_FUNCTION} AS actor_function, {', '.join(f'{how} AS {name}' for name, how in _REPORTED.items())} FROM fa),
    ro AS (SELECT DISTINCT seed_id, author_id AS actor, 'a' AS role FROM fx WHERE observed
      UNION SELECT seed_id, actor, CASE WHEN edge_type = 'quote' THEN 'q' WHEN edge_type = 'repost' THEN 'p' WHEN depth = 1 THEN 'r' ELSE 'd' END FROM ae
            WHERE seed_id IN (SELECT seed_id FROM fx WHERE observed))"""
_SUMS = """count(*) AS seeds, count(*) FILTER (status = 'observed') AS observed, count(*) FILTER (status = 'unavailable') AS unavailable, count(*) FILTER (status = 'failed') AS failed,
      count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (conversation) AS conversations, count(*) FILTER (g.observed AND d1 > 0) AS with_d1, count(*) FILTER (g.observed AND quotes > 0) AS with_quotes,
      count(*) FILTER (g.observed AND reposts > 0) AS with_reposts, CAST(coalesce(sum(d1) FILTER (g.observed), 0) AS BIGINT) AS depth1, CAST(coalesce(sum(d2) FILTER (g.observed), 0) AS BIGINT) AS depth2,
      CAST(coalesce(sum(quotes) FILTER (g.observed), 0) AS BIGINT) AS quote_edges, CAST(coalesce(sum(reposts) FILTER (g.observed), 0) AS BIGINT) AS repost_edges"""
_PEOPLE = """count(DISTINCT actor) FILTER (role = 'a') AS seed_authors, count(DISTINCT actor) FILTER (role = 'p') AS reposters, count(DISTINCT actor) FILTER (role <> 'a') AS participants,
      count(DISTINCT actor) FILTER (role IN ('r', 'd', 'q')) AS participants_no_reposts, count(DISTINCT actor) AS actors"""


def _summary_sql(members: dict[tuple[str, str], str], names: tuple[str, ...]) -> str:
    """members: (kind, value in SQL) -> condition."""
    g = " UNION ALL ".join(f"SELECT '{kind}' AS kind, {value} AS value, fx.* FROM fx WHERE {where}" for (kind, value), where in members.items())
    columns = ", ".join(f"x.{n}" for n in names)
    return f"""{_FX}, g AS ({g}), sx AS (SELECT kind, value, {_SUMS} FROM g GROUP BY 1, 2), px AS (SELECT kind, value, {_PEOPLE} FROM g JOIN ro USING (seed_id) GROUP BY 1, 2)
      SELECT {columns}, x.* EXCLUDE (kind, value), round(conversations / nullif(observed, 0), 6) AS csr, coalesce(seed_authors, 0) AS seed_authors, coalesce(reposters, 0) AS reposters,
        coalesce(participants, 0) AS participants, coalesce(participants_no_reposts, 0) AS participants_no_reposts, coalesce(actors, 0) AS actors
      FROM sx x LEFT JOIN px USING (kind, value)"""


register(
    "csr_population", lambda t: c.population_summary(facts(t), roles(t), populations()),
    f"WITH {_summary_sql({(p, chr(39) * 2): where for p, where in _POPULATIONS.items()}, ('kind AS population',))}",
)
_GROUPS = {(k, f"coalesce(CAST({k} AS VARCHAR), '(none)')"): "in_main" for k in KEYS} | {("all", "''"): "in_main"}
register("csr_by_group", lambda t: c.group_summary(main_facts(t), roles(t), KEYS), f"WITH {_summary_sql(_GROUPS, ('kind', 'value'))}")
register(
    "top_actor_removal", lambda t: c.without_top_authors(main_facts(t), roles(t)),
    f"""WITH {_FX}, tp AS (SELECT author_id, row_number() OVER (ORDER BY count(*) DESC, author_id) AS place FROM fx WHERE in_main GROUP BY 1),
      k AS (SELECT unnest([0, 1, 5, 10]) AS removed), g AS (SELECT removed, fx.* FROM fx JOIN tp USING (author_id) JOIN k ON place > removed WHERE in_main),
      s AS (SELECT removed, count(*) AS seeds, count(*) FILTER (g.observed) AS observed, round(count(*) FILTER (conversation) / nullif(count(*) FILTER (g.observed), 0), 6) AS csr,
            CAST(sum(d1 + d2) FILTER (g.observed) AS BIGINT) AS replies, CAST(sum(quotes) FILTER (g.observed) AS BIGINT) AS quotes FROM g GROUP BY 1),
      p AS (SELECT removed, count(DISTINCT actor) FILTER (role <> 'a') AS participants FROM g JOIN ro USING (seed_id) GROUP BY 1)
      SELECT * FROM s JOIN p USING (removed)""",
)
register(
    "actor_concentration", lambda t: c.producers(main_facts(t), graph.adopted(t)),
    graph._top_sql(f"""WITH {_FX} SELECT CASE edge_type WHEN 'reply' THEN 'replies' WHEN 'quote' THEN 'quotes' ELSE 'reposts' END AS kind, actor, count(*) AS n
      FROM ae WHERE seed_id IN (SELECT seed_id FROM fx WHERE in_main) GROUP BY 1, 2 UNION ALL SELECT 'seed_posts', author_id, count(*) FROM fx WHERE in_main GROUP BY 2""", "kind"),
)
register(
    "count_gap", lambda t: c.count_gaps(main_facts(t), {"d1": "reply_count", "quotes": "quote_count", "reposts": "repost_count"}),
    f"""WITH {_FX}, g AS (SELECT unnest(['d1', 'quotes', 'reposts']) AS kind, unnest([reply_count, quote_count, coalesce(repost_count, 0)]) AS own, unnest([d1, quotes, reposts]) AS got FROM fx WHERE in_main AND observed)
      SELECT kind, CAST(sum(own) AS BIGINT) AS reported, CAST(sum(got) AS BIGINT) AS retrieved, count(*) FILTER (got < own) AS seeds_short FROM g GROUP BY 1""",
)
register(
    "snapshot_vs_conv", lambda t: c.early_counts(main_facts(t), ["reply_count", "quote_count"]),
    f"WITH {_FX} SELECT reply_count > 0 OR quote_count > 0 AS early, conversation, count(*) AS seeds FROM fx WHERE in_main AND observed GROUP BY 1, 2",
)
_Q = lambda p, name: f"round(quantile_cont(h, {p}), 6) AS {name}"
register(
    "reply_delay", lambda t: c.reply_delays(main_facts(t), graph.adopted(t)),
    f"""WITH {_FX}, d AS (SELECT (epoch_us(event_time) - epoch_us(created_at)) / 3.6e9::DOUBLE AS h FROM ae JOIN fx USING (seed_id) WHERE edge_type = 'reply' AND in_main AND observed)
      SELECT count(*) AS n, round(avg(h), 6) AS mean_h, count(*) FILTER (h < 0) AS before_seed, round(avg(CAST(h <= 24 AS INTEGER)), 6) AS within_day, {_Q(0.25, 'q1_h')}, {_Q(0.5, 'median_h')},
        {_Q(0.75, 'q3_h')}, {_Q(0.9, 'p90_h')}, {_Q(0, 'least_h')}, {_Q(1, 'most_h')} FROM d""",
)
_MEASURES = ["d1", "d2", "quotes", "reposts", "participants"]


def measured(t):
    return main_facts(t).join(c.seed_participants(roles(t)).select("seed_id", "participants"), "seed_id", "left").fillna(0, ["participants"])


_PS = f"{_FX}, ps AS (SELECT seed_id, count(DISTINCT actor) FILTER (role <> 'a') AS participants FROM ro GROUP BY 1)"
register(
    "seed_distribution", lambda t: c.distributions(measured(t), _MEASURES),
    f"""WITH {_PS}, m AS (SELECT unnest({_MEASURES}) AS measure, unnest([d1, d2, quotes, reposts, coalesce(participants, 0)]) AS x FROM fx LEFT JOIN ps USING (seed_id) WHERE in_main AND observed)
      SELECT measure, count(*) AS n, CAST(sum(x) AS BIGINT) AS total, round(avg(x), 6) AS mean, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, max(x) AS most,
        round(avg(CAST(x = 0 AS INTEGER)), 6) AS zero_share FROM m GROUP BY 1""",
)
register(
    "seed_participants", lambda t: c.seed_participants(roles(t)),
    f"""WITH {_FX} SELECT seed_id, count(DISTINCT actor) FILTER (role IN ('r', 'd')) AS repliers, count(DISTINCT actor) FILTER (role = 'r') AS direct_repliers, count(DISTINCT actor) FILTER (role = 'q') AS quoters,
      count(DISTINCT actor) FILTER (role = 'p') AS reposters, count(DISTINCT actor) FILTER (role <> 'a') AS participants FROM ro GROUP BY 1""",
)
_SENSORS = f"""{_FX}, se AS (SELECT topic_key AS topic, count(*) AS s_post, CAST(sum(d1 + d2 + quotes) AS BIGINT) AS s_interaction FROM fx WHERE in_main AND observed GROUP BY 1),
    sa AS (SELECT topic_key AS topic, count(DISTINCT actor) AS s_actor FROM fx JOIN ro USING (seed_id) WHERE in_main AND role <> 'p' GROUP BY 1), sn AS (SELECT * FROM se JOIN sa USING (topic))"""
register(
    "sensors_by_topic", lambda t: c.sensors(main_facts(t), roles(t)),
    f"""WITH {_SENSORS} SELECT topic, s_post, s_actor, s_interaction, row_number() OVER (ORDER BY s_post DESC, topic) AS rank_post, row_number() OVER (ORDER BY s_actor DESC, topic) AS rank_actor,
      row_number() OVER (ORDER BY s_interaction DESC, topic) AS rank_interaction, round(s_interaction / s_post, 6) AS per_post FROM sn""",
)
_R = lambda s: f"rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2 AS r_{s}"
_PAIR = lambda a, b: f"SELECT '{a}~{b}' AS pair, round(CASE WHEN stddev_pop(r_{a}) > 0 AND stddev_pop(r_{b}) > 0 THEN corr(r_{a}, r_{b}) END, 6) AS rho, count(*) AS n FROM rk"
register(
    "spearman_topics", lambda t: c.sensor_correlations(staged(c.sensors(main_facts(t), roles(t)), "sensors")),
    f"""WITH {_SENSORS}, rk AS (SELECT {_R('s_post')}, {_R('s_actor')}, {_R('s_interaction')} FROM sn)
      {_PAIR('s_post', 's_actor')} UNION ALL {_PAIR('s_post', 's_interaction')} UNION ALL {_PAIR('s_actor', 's_interaction')}""",
)


def strict(t):
    latest = interaction.latest_outcome(t.outcomes)
    full = latest.where("outcome = 'success'").groupBy("seed_id").agg(F.countDistinct("endpoint").alias("n")).where("n = 2")
    return c.strict_summary(facts(t), full, "topic_key")


register(
    "csr_strict", strict,
    f"""WITH {_FX}, ok AS (SELECT seed_id, true AS full_ FROM la WHERE outcome = 'success' GROUP BY 1 HAVING count(*) = 2), g AS (SELECT * FROM fx LEFT JOIN ok USING (seed_id))
      SELECT topic_key, count(*) AS seeds, count(full_) AS observed, count(*) FILTER (full_ AND d1 + quotes > 0) AS conversations, round(count(*) FILTER (full_ AND d1 + quotes > 0) / nullif(count(full_), 0), 6) AS csr,
        count(*) FILTER (full_ AND d1 + d2 + quotes + reposts = 0) AS silent, count(*) FILTER (full_ AND d1 > reply_count) AS grown, count(*) FILTER (full_ AND d1 = reply_count) AS same,
        count(*) FILTER (full_ AND d1 < reply_count) AS fallen FROM g GROUP BY 1""",
)
