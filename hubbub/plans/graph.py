"""Interaction jobs over the adapted edges, seeds and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubbub.operators import interaction as i
from hubbub.plans.catalog import register

_LO = "lo AS (SELECT seed_id, endpoint, coalesce(max(run_id) FILTER (outcome <> 'failed'), min(run_id)) AS run_id FROM outcomes GROUP BY 1, 2), la AS (SELECT o.seed_id, o.endpoint, o.run_id, o.outcome FROM outcomes o JOIN lo USING (seed_id, endpoint, run_id))"
_ME = "ae AS (SELECT e.* FROM edges e JOIN la ON la.seed_id = e.seed_id AND la.run_id = e.run_id AND la.endpoint = 'thread'), me AS (SELECT seed_id, count(*) FILTER (edge_type = 'reply' AND depth = 1) AS d1, count(*) FILTER (edge_type = 'reply' AND depth = 2) AS d2, count(*) FILTER (edge_type = 'quote') AS quotes, count(*) FILTER (edge_type = 'repost') AS reposts, count(DISTINCT actor) AS actors FROM ae GROUP BY 1)"
_SS = f"{_LO}, ss AS (SELECT seed_id, CASE WHEN count(*) FILTER (outcome IN ('success', 'partial')) = 2 THEN 'observed' WHEN bool_or(outcome = 'unavailable') THEN 'unavailable' WHEN bool_or(outcome = 'failed') THEN 'failed' ELSE 'missing' END AS status FROM la GROUP BY 1)"


def adopted(t):
    return i.adopted_edges(t.edges, i.latest_outcome(t.outcomes))


register("adopted_edges", lambda t: adopted(t).select("edge_no", "seed_id", "run_id"), f"WITH {_LO}, {_ME} SELECT edge_no, seed_id, run_id FROM ae")
register("edge_key", lambda t: t.edges.select("edge_no", i.edge_key(F.col("edge_type"), F.col("actor"), F.when(F.col("target_id") % 5 > 0, F.col("target_id"))).alias("key")), "SELECT edge_no, substr(sha256(edge_type || '|' || actor || '|' || CASE WHEN target_id % 5 > 0 THEN CAST(target_id AS VARCHAR) ELSE 'None' END), 1, 32) AS key FROM edges")
register("latest_outcome", lambda t: i.latest_outcome(t.outcomes), f"WITH {_LO} SELECT * FROM la")
register("seed_metrics", lambda t: i.seed_metrics(adopted(t)), f"WITH {_LO}, {_ME} SELECT * FROM me")
register("seed_status", lambda t: i.seed_status(i.latest_outcome(t.outcomes)), f"WITH {_SS} SELECT * FROM ss")
for _by in ("topic_key", "actor_type", "has_cve", "in_main"):
    register(f"csr_by_{_by}", lambda t, by=_by: i.csr(t.seeds, i.seed_status(i.latest_outcome(t.outcomes)), i.seed_metrics(adopted(t)), by), f"""WITH {_SS}, {_ME}, j AS (SELECT s.{_by}, status = 'observed' AS seen, coalesce(d1, 0) + coalesce(quotes, 0) > 0 AS talk FROM seeds s LEFT JOIN ss USING (seed_id) LEFT JOIN me USING (seed_id))
      SELECT {_by}, count(*) AS seeds, count(*) FILTER (seen) AS observed, count(*) FILTER (seen AND talk) AS conversations, round(count(*) FILTER (seen AND talk) / nullif(count(*) FILTER (seen), 0), 6) AS csr FROM j GROUP BY 1""")
register("actor_reply_graph", lambda t: i.actor_reply_graph(t.edges, t.posts.select(F.col("post_id").alias("target_id"), F.col("author_id").alias("author"))), "WITH g AS (SELECT actor AS src, author_id AS dst, count(*) AS weight FROM edges JOIN posts ON post_id = target_id WHERE edge_type = 'reply' GROUP BY 1, 2) SELECT src, dst, weight, EXISTS (SELECT 1 FROM g h WHERE h.src = g.dst AND h.dst = g.src) AS mutual FROM g")


def facts(t):
    return i.seed_facts(t.seeds, i.seed_status(i.latest_outcome(t.outcomes)), i.seed_metrics(adopted(t)))


_FA = f"""{_SS}, {_ME}, fa AS (SELECT s.*, coalesce(status, 'missing') AS status, coalesce(d1, 0) AS d1, coalesce(d2, 0) AS d2, coalesce(quotes, 0) AS quotes, coalesce(reposts, 0) AS reposts,
      coalesce(status = 'observed', false) AS observed, coalesce(status = 'observed', false) AND coalesce(d1, 0) + coalesce(quotes, 0) > 0 AS conversation FROM seeds s LEFT JOIN ss USING (seed_id) LEFT JOIN me USING (seed_id))"""
register("csr_depth", lambda t: i.csr_depth(facts(t)), f"WITH {_FA} SELECT count(*) AS observed, count(*) FILTER (d1 > 0) AS with_d1, count(*) FILTER (d2 > 0) AS with_d2, round(count(*) FILTER (d1 > 0) / count(*), 6) AS share_d1, round(count(*) FILTER (d2 > 0) / count(*), 6) AS share_d2 FROM fa WHERE observed")
register("csr_weighted", lambda t: i.csr_weighted(facts(t), "actor_type"), f"WITH {_FA}, g AS (SELECT actor_type, count(*) AS n, count(*) FILTER (observed) AS seen, count(*) FILTER (conversation) AS talk FROM fa GROUP BY 1) SELECT round(sum(n * talk / seen) / sum(n), 6) AS csr_weighted FROM g WHERE seen > 0")
def _top_sql(source: str, by: str) -> str:
    tops = ", ".join(f"round(sum(n) FILTER (place <= {k}) / sum(n), 6) AS top_{k}" for k in (1, 5, 10))
    return f"""WITH c AS ({source}), r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC) AS place FROM c)
      SELECT {by}, count(*) AS actors, CAST(sum(n) AS BIGINT) AS total, round(sum(n * n) / (sum(n) * sum(n)), 6) AS hhi, {tops} FROM r GROUP BY 1"""


register("topic_concentration", lambda t: i.concentration(t.seeds.groupBy("topic_key", "author_id").agg(F.count(F.lit(1)).alias("n")), "topic_key", "n"), _top_sql("SELECT topic_key, author_id, count(*) AS n FROM seeds GROUP BY 1, 2", "topic_key"))
register("run_rollup", lambda t: i.run_rollup(t.outcomes), """WITH w AS (SELECT run_id, seed_id, max(CASE outcome WHEN 'failed' THEN 3 WHEN 'unavailable' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END) AS w FROM outcomes GROUP BY 1, 2)
      SELECT run_id, count(*) FILTER (w = 0) AS ok, count(*) FILTER (w = 1) AS partial, count(*) FILTER (w = 2) AS unavailable, count(*) FILTER (w = 3) AS failed FROM w GROUP BY 1""")
register("resume_anti", lambda t: i.resume_anti(t.seeds, t.outcomes, 2), "SELECT seed_id FROM seeds WHERE seed_id NOT IN (SELECT seed_id FROM outcomes WHERE run_id = 2 AND outcome IN ('success', 'partial') GROUP BY 1 HAVING count(*) = 2)")
register("repeat_run_diff", lambda t: i.repeat_run_diff(t.edges, 0, 1), """WITH k AS (SELECT edge_type, actor, seed_id, bool_or(run_id = 0) AS x, bool_or(run_id = 1) AS y FROM edges WHERE run_id < 2 GROUP BY 1, 2, 3)
      SELECT edge_type, count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (y AND NOT x) AS only_b, count(*) FILTER (x AND y) AS both FROM k GROUP BY 1""")
register("intensity_ratios", lambda t: i.intensity_ratios(t.edges, t.posts), """WITH e AS (SELECT CAST(event_time AS DATE) AS day, count(*) FILTER (edge_type = 'reply') AS r, count(*) FILTER (edge_type = 'quote') AS q, count(DISTINCT actor) AS a FROM edges GROUP BY 1),
      p AS (SELECT CAST(published_at AS DATE) AS day, count(*) AS n, count(DISTINCT author_id) AS u FROM posts GROUP BY 1) SELECT day, round(coalesce(r, 0) / n, 6) AS ri, round(coalesce(q, 0) / n, 6) AS qi, round(coalesce(a, 0) / u, 6) AS uar FROM p LEFT JOIN e USING (day)""")
register("conversation_features", lambda t: i.conversation_features(t.edges), "SELECT seed_id, count(*) AS size, max(depth) AS depth, count(DISTINCT actor) AS responders, count(DISTINCT target_id) AS targets, round(count(*) / count(DISTINCT target_id), 6) AS branching FROM edges WHERE edge_type = 'reply' GROUP BY 1")
_mentions = lambda t: t.posts.select("post_id", "author_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?i)\b(CVE-[0-9]{4}-[0-9]{4,7})\b"), F.lit(1)), F.upper))).alias("cve_id"))
register("kev_interaction", lambda t: i.interaction_by_cve(_mentions(t), t.edges, t.cve_records), """WITH m AS (SELECT DISTINCT post_id, author_id, upper(unnest(regexp_extract_all(text, '(?i)\\bCVE-[0-9]{4}-[0-9]{4,7}\\b'))) AS cve_id FROM posts),
      h AS (SELECT target_id AS post_id, count(*) AS hits FROM edges GROUP BY 1)
      SELECT m.cve_id, count(*) AS posts, count(DISTINCT author_id) AS authors, CAST(coalesce(sum(hits), 0) AS BIGINT) AS interactions, coalesce(bool_or(known_exploited), false) AS known_exploited FROM m LEFT JOIN h USING (post_id) LEFT JOIN cve_records r ON r.cve_id = m.cve_id GROUP BY 1""")


def chatty(t):
    """Texts with several handles, repeats in another case, and mail addresses, which are no handles."""
    more = F.concat(F.lit(" cc @Ann"), F.col("k") % 4, F.lit(", @ann"), F.col("k") % 4, F.lit(". write to x@mail.example or (@b_"), F.col("post_id") % 3, F.lit(")@"))
    return t.posts.withColumn("text", F.concat("text", F.when(F.col("post_id") % 3 > 0, more).otherwise(F.lit(""))))


register(
    "mention_edges", lambda t: i.mention_edges(chatty(t)),
    """WITH h AS (SELECT post_id, author_id, '@friend' AS handle FROM posts WHERE post_id % 12 = 4 UNION ALL SELECT post_id, author_id, '@ann' || (k % 4) FROM posts WHERE post_id % 3 > 0
      UNION ALL SELECT post_id, author_id, '@b_' || (post_id % 3) FROM posts WHERE post_id % 3 > 0) SELECT author_id, handle, count(*) AS posts FROM h GROUP BY 1, 2""",
)
register("outcome_counts", lambda t: i.outcome_counts(t.outcomes), "SELECT run_id, endpoint, count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome = 'partial') AS partial, count(*) FILTER (outcome = 'unavailable') AS unavailable, count(*) FILTER (outcome = 'failed') AS failed FROM outcomes GROUP BY 1, 2")
register(
    "negative_control", lambda t: i.negative_control(t.edges),
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY edge_no) AS a, row_number() OVER (ORDER BY md5(CAST(edge_no AS VARCHAR)), edge_no) AS b FROM edges WHERE edge_type = 'reply')
      SELECT x.edge_no, x.actor, y.target_id AS new_target FROM r x JOIN r y ON x.a = y.b""",
)
register("page_outcomes", lambda t: i.page_outcomes(t.fetches), """WITH f AS (SELECT *, min(page) FILTER (NOT ok) OVER w AS bad, max(page) OVER w AS most FROM fetches WINDOW w AS (PARTITION BY run_id, seed_id, endpoint)),
      l AS (SELECT run_id, seed_id, endpoint, page, ok, error, capped FROM f WHERE page = coalesce(bad, most)), x AS (SELECT run_id, seed_id, endpoint, page, unnest(items) AS item FROM f WHERE page < coalesce(bad, most + 1)),
      j AS (SELECT *, min(page) OVER (PARTITION BY run_id, seed_id, endpoint, item) AS first_page FROM x), n AS (SELECT run_id, seed_id, endpoint, count(*) AS n, count(DISTINCT item) AS seen, count(*) FILTER (page > first_page) AS again FROM j GROUP BY 1, 2, 3)
      SELECT run_id, seed_id, endpoint, page AS pages, CASE WHEN ok AND capped THEN 'partial' WHEN ok THEN 'success' WHEN page > 1 THEN 'partial' WHEN error IN ('not_found', 'blocked') THEN 'unavailable' ELSE 'failed' END AS outcome,
        CASE WHEN ok THEN coalesce(seen, 0) WHEN page > 1 THEN coalesce(n, 0) END AS items, CASE WHEN ok THEN coalesce(again, 0) END AS duplicates, CASE WHEN ok THEN capped END AS cap_hit FROM l LEFT JOIN n USING (run_id, seed_id, endpoint)""")
