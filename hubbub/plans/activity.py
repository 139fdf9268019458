"""Descriptive counts, chart data and run health over the adapted posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubbub.operators import descriptive as d
from hubbub.operators import health, metrics, runs
from hubbub.operators.content import cve_ids
from hubbub.operators.trend import in_window, instant
from hubbub.plans.adapters import AS_OF
from hubbub.plans.catalog import register
from hubbub.plans.signals import _CUR, _DAILY, _PREV, FLAGGED_SQL, flagged

_LAB = "lab AS (SELECT p.*, l.is_relevant, l.is_cyber, l.is_canada, l.low_info, l.topic_key FROM posts p JOIN labels l ON p.post_id = l.post_id AND l.label_version = 'v2')"


def version(t, v):
    return t.labels.where(F.col("label_version") == v)


def labelled(t):
    return t.posts.join(version(t, "v2").drop("label_version"), "post_id")


_PD = _LAB + ", pd AS (SELECT CAST(published_at AS DATE) AS day, count(*) AS posts, count(*) FILTER (is_relevant) AS relevant, count(DISTINCT author_id) FILTER (is_relevant) AS relevant_authors, count(*) FILTER (is_relevant AND low_info) AS relevant_low_info FROM lab GROUP BY 1)"
register("pilot_totals", lambda t: d.pilot_totals(labelled(t)), f"WITH {_LAB} SELECT count(*) AS posts, count(*) FILTER (is_relevant) AS relevant, count(*) FILTER (is_cyber) AS cyber, count(*) FILTER (is_canada) AS canada, count(DISTINCT author_id) AS authors, count(DISTINCT author_id) FILTER (is_relevant) AS relevant_authors, min(published_at) AS first_at, max(published_at) AS last_at FROM lab")
register("pilot_daily", lambda t: d.pilot_daily(labelled(t)), f"WITH {_PD} SELECT * FROM pd")
register("relevant_per_day", lambda t: d.relevant_per_day(d.pilot_daily(labelled(t))), f"WITH {_PD} SELECT round(avg(relevant), 6) AS mean, CAST(quantile_cont(relevant, 0.5) AS DOUBLE) AS median, min(relevant) AS least, max(relevant) AS most FROM pd")
register("weekday_profile", lambda t: d.weekday_profile(d.pilot_daily(labelled(t))), f"WITH {_PD} SELECT CAST(isodow(day) - 1 AS INTEGER) AS weekday, round(avg(relevant), 6) AS mean_relevant FROM pd GROUP BY 1")
register("by_lang", lambda t: d.counts_by(t.relevant, F.coalesce("lang", F.lit("(unknown)")).alias("lang")), "SELECT coalesce(lang, '(unknown)') AS lang, count(*) AS posts, count(DISTINCT author_id) AS authors FROM relevant GROUP BY 1")
register("by_topic", lambda t: d.posts_per_author(d.counts_by(t.relevant, "topic")), "SELECT topic, count(*) AS posts, count(DISTINCT author_id) AS authors, round(count(*) / count(DISTINCT author_id), 6) AS posts_per_author FROM relevant GROUP BY topic")
register("posts_per_author", lambda t: d.posts_per_author(d.counts_by(t.relevant, "topic", "lang")), "SELECT topic, lang, count(*) AS posts, count(DISTINCT author_id) AS authors, round(count(*) / count(DISTINCT author_id), 6) AS posts_per_author FROM relevant GROUP BY topic, lang")
register("by_mode", lambda t: d.counts_by(t.relevant.join(t.runs.select("run_id", "mode"), "run_id", "left"), "mode"), "SELECT mode, count(*) AS posts, count(DISTINCT author_id) AS authors FROM relevant LEFT JOIN runs USING (run_id) GROUP BY mode")
register("lag_by_mode", lambda t: d.lag_by_mode(t.posts, t.runs), """WITH l AS (SELECT mode, like_count, date_sub('second', published_at, collected_at) / 3600 AS lag FROM posts JOIN runs USING (run_id))
      SELECT mode, round(avg(lag), 6) AS mean_lag, round(quantile_cont(lag, 0.1), 6) AS p10, round(quantile_cont(lag, 0.5), 6) AS median, round(quantile_cont(lag, 0.9), 6) AS p90, round(avg(like_count), 6) AS mean_likes FROM l GROUP BY mode""")
register("bad_run_groups", lambda t: d.bad_run_groups(t.runs), """WITH g AS (SELECT mode, status, substr(split_part(detail, chr(10), 1), 1, 120) AS error, count(*) AS runs, min(run_id) AS first_run, max(run_id) AS last_run, CAST(sum(n_errors) AS BIGINT) AS errors, CAST(sum(n_fetched) AS BIGINT) AS fetched
      FROM runs WHERE status IN ('failed', 'partial') GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY runs DESC, mode, status, error) AS place FROM g""")
register("run_summary", lambda t: d.run_summary(t.runs), "SELECT mode, status, count(*) AS runs, CAST(sum(n_errors) AS BIGINT) AS errors FROM runs GROUP BY ALL")
register("overview", lambda t: d.pilot_totals(labelled(t)).select("posts", "relevant", "authors", "last_at"), f"WITH {_LAB} SELECT count(*) AS posts, count(*) FILTER (is_relevant) AS relevant, count(DISTINCT author_id) AS authors, max(published_at) AS last_at FROM lab")
register("source_stats", lambda t: d.source_stats(t.posts, version(t, "v2")), "SELECT source_key, count(*) AS posts, count(*) FILTER (is_relevant) AS relevant, min(published_at) AS first_at, max(published_at) AS last_at FROM posts p LEFT JOIN labels l ON p.post_id = l.post_id AND label_version = 'v2' GROUP BY source_key")
register("topic_daily", lambda t: d.topic_daily(t.posts, version(t, "v1"), version(t, "v2").where("post_id % 9 <> 0")), """SELECT CAST(published_at AS DATE) AS day, CASE WHEN b.post_id IS NULL THEN '(unlabelled)' ELSE coalesce(b.topic_key, 'other') END AS topic, count(*) AS posts, count(DISTINCT author_id) AS authors
      FROM posts p JOIN labels a ON a.post_id = p.post_id AND a.label_version = 'v1' AND a.is_relevant LEFT JOIN labels b ON b.post_id = p.post_id AND b.label_version = 'v2' AND b.post_id % 9 <> 0 GROUP BY 1, 2""")
register("topic_timeseries", lambda t: d.topic_timeseries(flagged(t)), f"WITH {FLAGGED_SQL} SELECT topic, CAST(published_at AS DATE) AS day, count(*) AS posts, count(DISTINCT author_id) AS authors, count(*) FILTER (NOT broadcast) AS organic_posts FROM flagged GROUP BY 1, 2")
register("topic_stats", lambda t: d.topic_stats(t.relevant), """WITH r AS (SELECT * FROM relevant WHERE topic_key IS NOT NULL), g AS (SELECT topic_key, coalesce(lang, '(unknown)') AS lang, count(*) AS n FROM r GROUP BY 1, 2),
      o AS (SELECT *, row_number() OVER (PARTITION BY topic_key ORDER BY n DESC, lang) AS place FROM g), t AS (SELECT topic_key, string_agg(lang, ',' ORDER BY place) AS top_langs FROM o WHERE place <= 5 GROUP BY topic_key)
      SELECT topic_key, count(*) AS posts, count(DISTINCT author_id) AS authors, count(*) FILTER (low_info) AS low_info, CAST(sum(like_count) AS BIGINT) AS likes, CAST(sum(repost_count) AS BIGINT) AS reposts, count(DISTINCT lang) AS langs,
        min(published_at) AS first_at, max(published_at) AS last_at, round(count(*) / count(DISTINCT author_id), 6) AS posts_per_author, any_value(top_langs) AS top_langs FROM r JOIN t USING (topic_key) GROUP BY topic_key""")
register("compare_periods", lambda t: d.compare_periods(t.relevant, AS_OF, 7), f"""WITH c AS (SELECT topic_key, count(*) FILTER ({_CUR}) AS posts, count(*) FILTER ({_PREV}) AS posts_before, count(DISTINCT author_id) FILTER ({_CUR}) AS authors, count(DISTINCT author_id) FILTER ({_PREV}) AS authors_before
      FROM relevant WHERE topic_key IS NOT NULL AND (({_CUR}) OR ({_PREV})) GROUP BY 1) SELECT *, CASE WHEN posts_before > 0 THEN round((posts - posts_before) / posts_before, 6) END AS growth, authors - authors_before AS author_delta FROM c""")
register("topic_by_source", lambda t: d.counts_by(t.relevant, "topic", "source_key"), "SELECT topic, source_key, count(*) AS posts, count(DISTINCT author_id) AS authors FROM relevant GROUP BY 1, 2")
_SCORE = "coalesce(like_count, 0) + 2 * coalesce(repost_count, 0) + coalesce(reply_count, 0)"
register("representative_posts", lambda t: d.representative_posts(t.relevant), f"WITH s AS (SELECT topic, post_id, author_id, {_SCORE} AS engagement, row_number() OVER (PARTITION BY topic ORDER BY {_SCORE} DESC, post_id) AS place FROM relevant WHERE NOT low_info) SELECT topic, post_id, author_id, engagement, place FROM s WHERE place <= 5")
register("diverse_posts", lambda t: d.diverse_posts(t.relevant), """WITH s AS (SELECT topic, post_id, author_id, coalesce(like_count, 0) + 2 * coalesce(repost_count, 0) + coalesce(reply_count, 0) AS engagement FROM relevant WHERE NOT low_info),
      a AS (SELECT *, row_number() OVER (PARTITION BY topic, author_id ORDER BY engagement DESC, post_id) AS nth FROM s),
      b AS (SELECT *, nth = 1 AND row_number() OVER (PARTITION BY topic, nth = 1 ORDER BY engagement DESC, post_id) <= 3 AS leads FROM a),
      c AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY leads DESC, engagement DESC, post_id) AS place FROM b) SELECT topic, post_id, author_id, engagement, place FROM c WHERE place <= 5""")
register("recent_posts", lambda t: d.top(t.relevant.select("post_id", "topic", F.substring("text", 1, 320).alias("text"), "published_at", cve_ids(F.col("text")).alias("cves")), 50, F.desc("published_at"), "post_id"), "SELECT * FROM (SELECT post_id, topic, substr(text, 1, 320) AS text, published_at, list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\\bCVE-\\d{4}-\\d{4,7}\\b'), lambda x: upper(x)))) AS cves, row_number() OVER (ORDER BY published_at DESC, post_id) AS place FROM relevant) WHERE place <= 50")
register("labelled_through", lambda t: d.labelled_through(t.posts, version(t, "v2"), 0.9), "WITH c AS (SELECT CAST(published_at AS DATE) AS day, count(l.post_id) / count(*) AS share FROM posts p LEFT JOIN labels l ON p.post_id = l.post_id AND label_version = 'v2' AND is_cyber IS NOT NULL GROUP BY 1) SELECT through, lowest, through + 1 AS until, through - 6 AS since, through - 13 AS before_since FROM (SELECT max(day) FILTER (share >= 0.9) AS through, round(min(share), 6) AS lowest FROM c)")
register("topic_top_authors", lambda t: d.top(t.relevant.where(in_window(F.col("published_at"), AS_OF, 7)).groupBy("topic", "author_handle").agg(F.count(F.lit(1)).alias("n")), 8, F.desc("n"), "author_handle", by=("topic",)), f"SELECT * FROM (SELECT topic, author_handle, count(*) AS n, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, author_handle) AS place FROM relevant WHERE {_CUR} GROUP BY 1, 2) WHERE place <= 8")
register("topic_feed_share", lambda t: flagged(t).groupBy("topic").agg(F.round(F.count_if("broadcast") / F.count(F.lit(1)), 6).alias("feed_share")), f"WITH {FLAGGED_SQL} SELECT topic, round(count(*) FILTER (broadcast) / count(*), 6) AS feed_share FROM flagged GROUP BY topic")
register("topic_split", lambda t: d.topic_split(flagged(t)), f"WITH {FLAGGED_SQL} SELECT topic, count(*) AS raw, count(*) FILTER (NOT broadcast) AS organic, count(DISTINCT author_id) AS raw_authors, count(DISTINCT author_id) FILTER (NOT broadcast) AS organic_authors FROM flagged GROUP BY topic")
register("trajectory", lambda t: d.trajectory(flagged(t)), f"WITH {FLAGGED_SQL}, g AS (SELECT topic, CAST(published_at AS DATE) AS day, count(*) AS raw, count(*) FILTER (NOT broadcast) AS organic, count(DISTINCT author_id) AS authors FROM flagged GROUP BY 1, 2) SELECT *, round(raw / CAST(sum(raw) OVER (PARTITION BY day) AS BIGINT), 6) AS share FROM g")
register("rolling_centered", lambda t: metrics.rolling_centered(metrics.filled_daily(t.relevant), 5), f"WITH {_DAILY} SELECT topic, day, CASE WHEN count(*) OVER w = 5 THEN round(avg(n) OVER w, 6) END AS rolling FROM filled WINDOW w AS (PARTITION BY topic ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
register("week_heatmap", lambda t: d.week_heatmap(flagged(t)), f"""WITH {FLAGGED_SQL}, g AS (SELECT CAST(date_trunc('week', published_at) AS DATE) AS week, topic, count(*) AS n FROM flagged WHERE NOT broadcast GROUP BY 1, 2),
      e AS (SELECT min(week) AS a, max(week) AS b, count(DISTINCT week) AS weeks FROM g), x AS (SELECT *, CAST(sum(n) OVER (PARTITION BY week) AS BIGINT) AS total FROM g) SELECT week, topic, n, round(n / total, 6) AS share FROM x, e WHERE (weeks <= 2 OR (week > a AND week < b)) AND total >= 4""")
register("actor_topic_edges", lambda t: d.actor_topic_edges(flagged(t)), f"WITH {FLAGGED_SQL}, g AS (SELECT author_id, topic, count(*) AS weight, CAST(sum(like_count + repost_count) AS BIGINT) AS engagement, bool_or(broadcast) AS broadcast FROM flagged GROUP BY 1, 2) SELECT *, count(*) OVER (PARTITION BY author_id) AS topics FROM g")
register("lorenz_gini", lambda t: d.lorenz_gini(t.relevant.groupBy("topic", "author_id").agg(F.count(F.lit(1)).alias("n")), "topic"), """WITH c AS (SELECT topic, author_id, count(*) AS n FROM relevant GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n, author_id) AS i FROM c)
      SELECT topic, count(*) AS actors, CAST(sum(n) AS BIGINT) AS total, round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini FROM r GROUP BY topic""")

# runs and health
register("plan_windows", lambda t: d.plan_windows(t.runs.select("run_id", F.col("window_start").alias("since"), F.col("window_end").alias("until")).distinct(), 7), """SELECT window_start AS since, window_end AS until, window_start + INTERVAL 1 DAY * (7 * i) AS start, least(window_start + INTERVAL 1 DAY * (7 * (i + 1)), window_end) AS stop
      FROM (SELECT *, unnest(range(0, 60)) AS i FROM (SELECT DISTINCT run_id, window_start, window_end FROM runs)) WHERE window_start + INTERVAL 1 DAY * (7 * i) < window_end""")
register("incremental_window", lambda t: runs.incremental_window(t.runs, AS_OF), f"SELECT source_key, coalesce(max(window_end) FILTER (status = 'success') - INTERVAL 15 MINUTE, TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS since, TIMESTAMP '{AS_OF}' AS until FROM runs GROUP BY source_key")
register("reap_stale_runs", lambda t: runs.reap_stale(t.runs, "2024-02-01 12:00:00"), "SELECT run_id, CASE WHEN status = 'running' AND started_at < TIMESTAMP '2024-02-01 12:00:00' - INTERVAL 6 HOUR THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' AND started_at < TIMESTAMP '2024-02-01 12:00:00' - INTERVAL 6 HOUR THEN concat_ws('; ', detail, 'stale') ELSE detail END AS detail FROM runs")
register("run_status", lambda t: runs.run_status(t.posts.select("run_id", F.to_date("published_at").alias("window"), "source_key", (F.col("k") > 0).alias("complete"))), "WITH p AS (SELECT run_id, CAST(published_at AS DATE) AS w, source_key, bool_and(k > 0) AS complete FROM posts GROUP BY ALL) SELECT run_id, count(*) FILTER (NOT complete) AS incomplete, CASE WHEN count(*) FILTER (NOT complete) > 0 THEN 'partial' ELSE 'success' END AS status FROM p GROUP BY run_id")
register("health_last_success", lambda t: health.last_success(t.runs, AS_OF), f"SELECT source_key, max(window_end) FILTER (status = 'success') AS last_success, round(date_sub('second', max(window_end) FILTER (status = 'success'), TIMESTAMP '{AS_OF}') / 3600, 6) AS age_hours FROM runs GROUP BY source_key")
register("health_daily_runs", lambda t: health.daily_runs(t.runs, "2024-02-03 00:00:00"), "SELECT CAST(started_at AS DATE) AS day, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'partial') AS \"partial\", count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running FROM runs WHERE started_at >= TIMESTAMP '2024-02-03' - INTERVAL 7 DAY AND started_at < TIMESTAMP '2024-02-03' GROUP BY 1")
register("health_error_rate", lambda t: health.error_rate(t.runs), "SELECT source_key, count(*) AS runs, count(*) FILTER (status IN ('failed', 'partial')) AS degraded, round(count(*) FILTER (status IN ('failed', 'partial')) / count(*), 6) AS degraded_share FROM runs GROUP BY source_key")
register("health_recent_errors", lambda t: d.top(t.runs.where("detail is not null").select("run_id", "source_key", "status", "detail", "started_at"), 5, F.desc("started_at"), "run_id"), "SELECT * FROM (SELECT run_id, source_key, status, detail, started_at, row_number() OVER (ORDER BY started_at DESC, run_id) AS place FROM runs WHERE detail IS NOT NULL) WHERE place <= 5")
register("health_freshness", lambda t: t.posts.groupBy("source_key").agg(F.max("published_at").alias("newest"), F.max("collected_at").alias("collected")).withColumn("lag_hours", F.round(F.timestamp_diff("SECOND", F.col("newest"), instant("2024-02-03 00:00:00")) / 3600, 6)), "SELECT source_key, max(published_at) AS newest, max(collected_at) AS collected, round(date_sub('second', max(published_at), TIMESTAMP '2024-02-03') / 3600, 6) AS lag_hours FROM posts GROUP BY 1")
register("health_gaps", lambda t: d.gaps(t.posts, "2023-12-25 00:00:00", "2024-02-10 00:00:00"), "SELECT CAST(x AS DATE) AS day FROM (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-09', INTERVAL 1 DAY)) AS x) WHERE CAST(x AS DATE) NOT IN (SELECT CAST(published_at AS DATE) FROM posts)")
register("data_health", lambda t: health.data_health(t.posts, t.runs, "2024-01-15 00:00:00", "2024-02-05 00:00:00"), """WITH b AS (SELECT count(*) AS bad_runs FROM runs WHERE status IN ('failed', 'partial')), g AS (SELECT count(*) AS gap_days FROM (SELECT unnest(generate_series(DATE '2024-01-15', DATE '2024-02-04', INTERVAL 1 DAY)) AS x) WHERE CAST(x AS DATE) NOT IN (SELECT CAST(published_at AS DATE) FROM posts)),
      m AS (SELECT count(DISTINCT mode) AS modes, count(*) AS posts FROM posts JOIN runs USING (run_id) WHERE published_at >= TIMESTAMP '2024-01-15' AND published_at < TIMESTAMP '2024-02-05') SELECT bad_runs, gap_days, modes, posts, bad_runs > 0 OR gap_days > 0 OR modes > 1 AS has_problem FROM b, g, m""")
register("collection_health", lambda t: t.runs.groupBy("source_key", "mode", "status").agg(F.count(F.lit(1)).alias("runs")), "SELECT source_key, mode, status, count(*) AS runs FROM runs GROUP BY ALL")
register("last_run_per_source", lambda t: d.top(t.runs.select("source_key", "run_id", "status", "started_at"), 1, F.desc("started_at"), "run_id", by=("source_key",)), "SELECT * FROM (SELECT source_key, run_id, status, started_at, row_number() OVER (PARTITION BY source_key ORDER BY started_at DESC, run_id) AS place FROM runs) WHERE place = 1")
register("source_status", lambda t: health.source_status(t.spark.createDataFrame([("s0", True), ("s1", True), ("s2", False), ("s9", True)], "source_key string, enabled boolean"), d.source_stats(t.posts, version(t, "v2"))), "SELECT c.source_key, enabled, coalesce(posts, 0) AS posts, last_at FROM (VALUES ('s0', true), ('s1', true), ('s2', false), ('s9', true)) c(source_key, enabled) LEFT JOIN (SELECT source_key, count(*) AS posts, max(published_at) AS last_at FROM posts GROUP BY 1) s USING (source_key)")
