"""Scores of label versions over the adapted labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubbub.operators import evaluation as e
from hubbub.operators import authors
from hubbub.operators.descriptive import top
from hubbub.plans import signals
from hubbub.plans.catalog import register
from hubbub.sources.staging import staging_path


def version(t, v):
    return t.labels.where(F.col("label_version") == v)


_ST = "st AS (SELECT *, CASE WHEN is_cyber THEN 'is_cyber' WHEN NOT is_cyber THEN 'not_is_cyber' END || '/' || CASE WHEN is_canada THEN 'is_canada' WHEN NOT is_canada THEN 'not_is_canada' END AS stratum FROM labels WHERE label_version = 'v2')"
register("stratified_sample", lambda t: e.stratified_sample(version(t, "v2"), 25, "seed"), f"WITH {_ST} SELECT * FROM (SELECT post_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5(post_id || 'seed'), post_id) AS place FROM st WHERE stratum IS NOT NULL) WHERE place <= 25")
register("stratum_sizes", lambda t: e.stratum_sizes(version(t, "v2")), f"WITH {_ST} SELECT stratum, count(*) AS n FROM st WHERE stratum IS NOT NULL GROUP BY 1")


def interval(t):
    rows = version(t, "v2").groupBy("topic_key").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_relevant").alias("hits"))
    low, high = e.wilson_ci(F.col("hits"), F.col("n"))
    return rows.select("*", low.alias("low"), high.alias("high"))


register("wilson_ci", interval, """WITH g AS (SELECT topic_key, count(*) AS n, count(*) FILTER (is_relevant) AS hits FROM labels WHERE label_version = 'v2' GROUP BY 1), p AS (SELECT *, hits / n AS p, 1.96::DOUBLE AS z FROM g)
      SELECT topic_key, n, hits, round(greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0), 6) AS low, round(least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1), 6) AS high FROM p""")
_AB = "labels a JOIN labels b ON a.post_id = b.post_id AND a.label_version = 'v1' AND b.label_version = 'v2'"
register("gate_diff", lambda t: e.gate_diff(version(t, "v1"), version(t, "v2")), f"""SELECT b.is_cyber, b.is_canada, count(*) AS posts, 'a_only' AS direction FROM {_AB} WHERE a.is_relevant AND NOT b.is_relevant GROUP BY 1, 2
      UNION ALL SELECT NULL, NULL, count(*), 'b_only' FROM {_AB} WHERE b.is_relevant AND NOT a.is_relevant""")
register("version_transition", lambda t: e.version_transition(version(t, "v1"), version(t, "v2")), f"SELECT b.derived_chain, count(*) AS posts, count(*) FILTER (b.is_relevant) AS relevant, count(*) FILTER (b.is_relevant AND NOT a.is_relevant) AS gained, count(*) FILTER (a.is_relevant AND NOT b.is_relevant) AS lost FROM {_AB} GROUP BY 1")
register("label_migration", lambda t: e.label_migration(version(t, "v1"), version(t, "v2")), f"SELECT coalesce(a.topic_key, 'other') AS before, coalesce(b.topic_key, 'other') AS after, count(*) AS posts FROM {_AB} WHERE a.is_relevant GROUP BY 1, 2")


def flows(t):
    return e.label_migration(version(t, "v1"), version(t, "v2"))


_FLOW = f"fl AS (SELECT coalesce(a.topic_key, 'other') AS x, coalesce(b.topic_key, 'other') AS y FROM {_AB} WHERE a.is_relevant)"
register("label_migration_topics", lambda t: e.migration_topics(flows(t)), f"""WITH {_FLOW}, k AS (SELECT DISTINCT x AS topic FROM fl UNION SELECT y FROM fl),
      g AS (SELECT topic, count(*) FILTER (x = topic) AS a, count(*) FILTER (y = topic) AS b, count(*) FILTER (x = topic AND x <> y) AS "left", count(*) FILTER (y = topic AND x <> y) AS gained FROM k JOIN fl ON topic = x OR topic = y GROUP BY 1)
      SELECT *, b - a AS delta, CASE WHEN a > 0 THEN round((b - a) / a, 6) END AS change FROM g""")
register("label_flows_top", lambda t: top(flows(t).where("before <> after"), 12, F.desc("posts"), "before", "after"), f"""WITH {_FLOW}, g AS (SELECT x AS before, y AS after, count(*) AS posts FROM fl WHERE x <> y GROUP BY 1, 2)
      SELECT * FROM (SELECT *, row_number() OVER (ORDER BY posts DESC, before, after) AS place FROM g) WHERE place <= 12""")


def pairs(t):
    key = lambda v, c: version(t, v).select("post_id", F.coalesce("topic_key", F.lit("other")).alias(c))
    return key("v1", "a").join(key("v2", "b"), "post_id")


register("cohen_kappa", lambda t: e.cohen_kappa(pairs(t), "a", "b"), f"""WITH p AS (SELECT coalesce(a.topic_key, 'other') AS x, coalesce(b.topic_key, 'other') AS y FROM {_AB}), n AS (SELECT count(*) AS n, avg(CAST(x = y AS INTEGER)) AS po FROM p),
      m AS (SELECT sum(u.c * v.c) AS s FROM (SELECT x, count(*) AS c FROM p GROUP BY 1) u JOIN (SELECT y, count(*) AS c FROM p GROUP BY 1) v ON x = y)
      SELECT round(po, 6) AS agreement, round((po - s / (n * n)) / (1 - s / (n * n)), 6) AS kappa FROM n, m""")


register("gate_eval", lambda t: e.gate_eval(version(t, "v1").withColumn("stratum", e.stratum()), version(t, "v2"), "is_cyber"), """WITH x AS (SELECT CASE WHEN a.is_cyber THEN 'is_cyber' ELSE 'not_is_cyber' END || '/' || CASE WHEN a.is_canada THEN 'is_canada' ELSE 'not_is_canada' END AS stratum, a.is_cyber AS t, b.is_cyber AS p FROM labels a LEFT JOIN labels b ON a.post_id = b.post_id AND b.label_version = 'v2' WHERE a.label_version = 'v1'),
      g AS (SELECT stratum, count(*) FILTER (t AND p IS NOT NULL) AS positives, count(*) FILTER (t AND p) AS hits, count(*) FILTER (NOT t AND p IS NOT NULL) AS negatives, count(*) FILTER (NOT t AND NOT p) AS passed, count(*) FILTER (p IS NULL) AS unjudged FROM x GROUP BY ROLLUP (stratum))
      SELECT *, round(hits / nullif(positives, 0), 6) AS recall, round(passed / nullif(negatives, 0), 6) AS specificity FROM g""")
# Which kinds of account are compared, as (name, one side, other side).
RANK_PAIRS = [
    ("feeds_individuals", ("intel_feed_raw",), ("organic_attention", "individual_unheard")),
    ("promotion_individuals", ("promotion_unheard", "promotion_reaching"), ("organic_attention", "individual_unheard")),
    ("feeds_promotion", ("intel_feed_raw",), ("promotion_unheard", "promotion_reaching")),
]


def engagement_sides(t):
    """A row for each pair that a settled relevant post's account belongs to."""
    rows = t.relevant.where(authors.settled()).join(signals.profiles(t).select("author_id", "actor_type"), "author_id")
    one = [F.when(F.col("actor_type").isin(*a, *b), F.struct(F.lit(name).alias("pair"), F.col("actor_type").isin(*a).alias("side"))) for name, a, b in RANK_PAIRS]
    rows = rows.select((F.col("like_count") + F.col("repost_count")).alias("x"), F.explode(F.array_compact(F.array(*one))).alias("p"))
    return rows.select("p.pair", "p.side", "x")


_SIDES = " UNION ALL ".join(
    f"SELECT '{name}' AS pair, actor_type IN ({', '.join(map(repr, a))}) AS side, x FROM v WHERE actor_type IN ({', '.join(map(repr, a + b))})" for name, a, b in RANK_PAIRS
)
register("mann_whitney", lambda t: e.mann_whitney(engagement_sides(t), "side", "x", ["pair"]), f"""WITH {signals.PROFILES_SQL},
      v AS (SELECT actor_type, like_count + repost_count AS x FROM relevant JOIN prof USING (author_id) WHERE collected_at - published_at >= INTERVAL 24 HOUR AND repost_count IS NOT NULL AND like_count IS NOT NULL),
      sides AS ({_SIDES}), r AS (SELECT *, rank() OVER (PARTITION BY pair ORDER BY x) + (count(*) OVER (PARTITION BY pair, x) - 1) / 2 AS r, count(*) OVER (PARTITION BY pair, x) AS t FROM sides),
      q AS (SELECT *, row_number() OVER (PARTITION BY pair, side ORDER BY x) AS nth, count(*) OVER (PARTITION BY pair, side) AS n FROM r),
      s AS (SELECT pair, count(*) FILTER (side) AS n_a, count(*) FILTER (NOT side) AS n_b, max(x) FILTER (side AND nth = n // 2 + 1) AS median_a, max(x) FILTER (NOT side AND nth = n // 2 + 1) AS median_b,
        sum(r) FILTER (side) AS r, sum(t * t - 1)::DOUBLE AS ties FROM q GROUP BY pair),
      w AS (SELECT *, r - n_a * (n_a + 1) / 2 AS u, sqrt(n_a * n_b / 12 * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1)))) AS spread FROM s WHERE n_a >= 5 AND n_b >= 5),
      y AS (SELECT *, abs(CASE WHEN spread > 0 THEN greatest(abs(u - n_a * n_b / 2) - 0.5, 0) / spread ELSE 0 END) / sqrt(2.0::DOUBLE) AS y FROM w),
      k AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * y) AS k FROM y)
      SELECT pair, n_a, n_b, median_a, median_b, u, round(1 - 2 * u / (n_a * n_b), 6) AS effect, round(least(1.0::DOUBLE, ((((1.061405429::DOUBLE * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k * exp(-y * y)), 6) AS p FROM k""")


def daily_predictions(t):
    flag = F.col("is_relevant").cast("int")
    days = t.posts.select("post_id", F.to_date("published_at").alias("day")).join(version(t, "v2").select("post_id", flag.alias("p")), "post_id")
    return e.ppi_daily(days, version(t, "v1").where("post_id % 10 = 0").select("post_id", flag.alias("y")))


register("ppi_daily", daily_predictions, """WITH x AS (SELECT CAST(published_at AS DATE) AS day, CAST(b.is_relevant AS INTEGER) AS p, CASE WHEN post_id % 10 = 0 THEN CAST(a.is_relevant AS INTEGER) END - CAST(b.is_relevant AS INTEGER) AS d
      FROM posts JOIN labels a USING (post_id) JOIN labels b USING (post_id) WHERE a.label_version = 'v1' AND b.label_version = 'v2'),
      g AS (SELECT day, count(*) AS n, count(d) AS n_labelled, avg(p) + avg(d) AS rate, 1.96::DOUBLE * sqrt(var_samp(p) / count(*) + var_samp(d) / nullif(count(d), 0)) AS half FROM x GROUP BY 1)
      SELECT day, n, n_labelled, CASE WHEN n_labelled > 1 AND n > 1 THEN round(rate, 6) END AS rate, CASE WHEN n_labelled > 1 AND n > 1 THEN round(rate - half, 6) END AS low, CASE WHEN n_labelled > 1 AND n > 1 THEN round(rate + half, 6) END AS high FROM g""")
register("verify_evidence", lambda t: e.verify_evidence(t.posts.where("in_reply_to is not null").select(F.col("in_reply_to").alias("uri")), t.relevant.select("uri"), "uri"), "SELECT in_reply_to AS uri, count(*) AS times FROM posts WHERE in_reply_to IS NOT NULL AND in_reply_to NOT IN (SELECT uri FROM relevant) GROUP BY 1")


def review_round_trip(t):
    path = staging_path(t.spark, "review")
    filled = lambda c, n: F.when(F.col("post_id") % n > 0, F.col(c)).alias(f"true_{c}")
    rows = t.posts.select("post_id", "text").join(version(t, "v1"), "post_id")
    e.export_review(rows.select("post_id", filled("is_cyber", 3), filled("is_canada", 4), "text"), path)
    back = e.load_review(t.spark, path, ["true_is_cyber", "true_is_canada"])
    return back.select(F.col("post_id").cast("long").alias("post_id"), "true_is_cyber", "true_is_canada", "text")


register("review_tsv", review_round_trip, "SELECT post_id, is_cyber AS true_is_cyber, is_canada AS true_is_canada, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM posts JOIN labels USING (post_id) WHERE label_version = 'v1' AND post_id % 3 > 0 AND post_id % 4 > 0")
