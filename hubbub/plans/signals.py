"""Trends, significance and accounts over the adapted posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubbub.operators import authors, interaction, metrics, nullmodel, trend
from hubbub.plans.adapters import AS_OF
from hubbub.plans.catalog import register

W = 7
_CUR = f"published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND published_at < TIMESTAMP '{AS_OF}'"
_PREV = f"published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND published_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"

ACTIVITY_SQL = """activity AS (SELECT author_id, count(*) AS n_posts, count(DISTINCT CAST(published_at AS DATE)) AS n_days, round(avg(like_count + repost_count), 6) AS avg_engagement,
      count(*) FILTER (collected_at - published_at >= INTERVAL 24 HOUR AND like_count + repost_count IS NOT NULL) AS n_settled,
      count(*) FILTER (collected_at - published_at >= INTERVAL 24 HOUR AND like_count + repost_count = 0) AS n_settled_zero FROM posts GROUP BY author_id),
    rated AS (SELECT *, CASE WHEN n_settled > 0 THEN round(n_settled_zero / n_settled, 6) END AS zero_rate FROM activity),
    bc AS (SELECT * FROM rated WHERE n_posts >= 5 AND n_days >= 4 AND zero_rate >= 0.6)"""
FLAGGED_SQL = ACTIVITY_SQL + ", flagged AS (SELECT r.*, b.author_id IS NOT NULL AS broadcast FROM relevant r LEFT JOIN bc b USING (author_id))"
AUDIENCE_SQL = """aud AS (SELECT author_id, count(*) AS n_posts, count(*) FILTER (collected_at - published_at >= INTERVAL 24 HOUR AND like_count + repost_count IS NOT NULL) AS n_settled,
      round(avg(like_count + repost_count) FILTER (collected_at - published_at >= INTERVAL 24 HOUR), 6) AS mean_engagement FROM posts GROUP BY author_id),
    audience AS (SELECT *, CASE WHEN n_settled = 0 THEN 'unknown' WHEN mean_engagement >= 1 THEN 'engaged' ELSE 'unheard' END AS audience FROM aud)"""
PROFILES_SQL = AUDIENCE_SQL + """,
    fn AS (SELECT DISTINCT author_id, CASE CAST(substr(author_id, 2) AS BIGINT) % 6 WHEN 0 THEN 'incident_feed' WHEN 1 THEN 'news_media' WHEN 2 THEN 'promotion'
        WHEN 3 THEN 'individual' WHEN 4 THEN 'org_other' END AS function FROM posts),
    prof AS (SELECT author_id, n_posts, audience, function,
        CASE WHEN function IS NULL OR audience = 'unknown' OR (function IN ('incident_feed', 'promotion') AND n_posts < 3) THEN 'unclassified'
          WHEN audience = 'engaged' THEN CASE function WHEN 'incident_feed' THEN 'intel_feed_amplified' WHEN 'promotion' THEN 'promotion_reaching' WHEN 'news_media' THEN 'news_with_reach'
            WHEN 'individual' THEN 'organic_attention' ELSE 'org_reaching' END
          ELSE CASE function WHEN 'incident_feed' THEN 'intel_feed_raw' WHEN 'promotion' THEN 'promotion_unheard' WHEN 'news_media' THEN 'news_syndicated'
            WHEN 'individual' THEN 'individual_unheard' ELSE 'org_unheard' END END AS actor_type,
        CASE WHEN n_posts >= 5 THEN 'established' WHEN n_posts >= 3 THEN 'provisional' ELSE 'single' END AS tier,
        CASE WHEN n_posts >= 5 THEN 0.9 WHEN n_posts >= 3 THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence, 'p1' AS profile_version FROM audience JOIN fn USING (author_id))"""


def _compare_sql(source: str) -> str:
    return f"""t AS (SELECT topic, count(*) FILTER ({_CUR}) AS n_cur, count(*) FILTER ({_PREV}) AS n_prev, count(DISTINCT author_id) FILTER ({_CUR}) AS authors_cur,
        count(DISTINCT author_id) FILTER ({_PREV}) AS authors_prev FROM {source} WHERE ({_CUR}) OR ({_PREV}) GROUP BY topic),
      compared AS (SELECT *, n_cur - n_prev AS abs_delta, CASE WHEN n_prev > 0 THEN round((n_cur - n_prev) / n_prev, 6) END AS rel_growth,
        round(n_cur / CAST(sum(n_cur) OVER () AS BIGINT), 6) AS share_cur, round(n_prev / nullif(CAST(sum(n_prev) OVER () AS BIGINT), 0), 6) AS share_prev FROM t)"""


def activity(t):
    return authors.author_activity(t.posts)


def flagged(t):
    return authors.flag_broadcast(t.relevant, activity(t))


def functions(t):
    names = F.array(*map(F.lit, ("incident_feed", "news_media", "promotion", "individual", "org_other")))
    n = (F.substring("author_id", 2, 20).cast("long") % 6).cast("int")
    return t.posts.select("author_id").distinct().withColumn("function", F.get(names, n))


def profiles(t):
    return authors.build_profiles(authors.measure_audience(t.posts), functions(t), "p1")


def broadcast(t):
    return activity(t).where(authors.is_broadcast())


register("trend_compare", lambda t: trend.trend_compare(t.relevant, AS_OF, W), f"WITH {_compare_sql('relevant')} SELECT * FROM compared")
_EXCL = f"{ACTIVITY_SQL}, organic AS (SELECT * FROM relevant r WHERE NOT EXISTS (SELECT 1 FROM bc WHERE bc.author_id = r.author_id)), {_compare_sql('organic')}"
register("trend_excl_authors", lambda t: trend.trend_compare(t.relevant, AS_OF, W, broadcast(t)), f"WITH {_EXCL} SELECT * FROM compared")
register(
    "trend_rank", lambda t: trend.trend_rank(trend.trend_compare(t.relevant, AS_OF, W, broadcast(t))),
    f"""WITH {_EXCL} SELECT *, round(share_cur - share_prev, 6) AS share_delta,
      row_number() OVER (ORDER BY abs_delta DESC, rel_growth DESC NULLS LAST, topic DESC) AS rank FROM compared WHERE n_cur >= 5""",
)
register("window_bounds", lambda t: trend.window_bounds(t.spark, AS_OF, W).crossJoin(F.broadcast(t.events.agg(F.max("ts").alias("newest")))), f"""SELECT TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AS prev_start, TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS prev_end,
      TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS cur_start, TIMESTAMP '{AS_OF}' AS cur_end, (SELECT max(ts) FROM events) AS newest""")
register("recent_topics", lambda t: trend.recent_topics(t.relevant, AS_OF, W), f"""WITH t AS (SELECT topic, count(*) FILTER ({_CUR}) AS n, count(*) FILTER ({_PREV}) AS n_before, count(DISTINCT author_id) FILTER ({_CUR}) AS authors FROM relevant GROUP BY topic),
      d AS (SELECT *, n - n_before AS delta, row_number() OVER (ORDER BY n DESC, topic) AS place FROM t WHERE n > 0)
      SELECT *, CASE WHEN n_before = 0 THEN 'newly' WHEN delta > 0 THEN 'increasing' WHEN delta < 0 THEN 'decreasing' ELSE 'unchanged' END AS activity, place = 1 AS most_discussed FROM d WHERE place <= 10""")
register("rate_growth", lambda t: trend.rate_growth(t.relevant, AS_OF, 3, 14), f"""WITH r AS (SELECT topic, count(*) FILTER (published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY AND published_at < TIMESTAMP '{AS_OF}') / 3 AS r,
      count(*) FILTER (published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 17 DAY AND published_at < TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY) / 14 AS b FROM relevant GROUP BY topic)
      SELECT topic, round(r, 6) AS recent_rate, round(b, 6) AS base_rate, round((r - b) / greatest(b, 0.1::DOUBLE), 6) AS rate_growth FROM r""")

# accounts
register("author_activity", activity, f"WITH {ACTIVITY_SQL} SELECT * FROM rated")
register("broadcast_authors", lambda t: authors.broadcast_authors(activity(t)), f"WITH {ACTIVITY_SQL} SELECT author_id, n_posts, n_days, zero_rate, row_number() OVER (ORDER BY n_posts DESC, author_id) AS place FROM bc")
register("broadcast_share", lambda t: authors.broadcast_share(activity(t)), f"""WITH {ACTIVITY_SQL}, s AS (SELECT CAST((SELECT coalesce(sum(n_posts), 0) FROM bc) AS BIGINT) AS posts, CAST(sum(n_posts) AS BIGINT) AS all_posts, (SELECT count(*) FROM bc) AS authors, count(*) AS all_authors FROM rated)
      SELECT *, coalesce(round(posts / nullif(all_posts, 0), 6), 0) AS post_share, coalesce(round(authors / nullif(all_authors, 0), 6), 0) AS author_share FROM s""")
register("broadcast_gap", lambda t: authors.broadcast_gap(flagged(t)), f"WITH {FLAGGED_SQL} SELECT broadcast, count(*) AS posts, round(avg(like_count + repost_count), 6) AS mean_engagement, round(avg(CAST(like_count + repost_count = 0 AS INTEGER)), 6) AS zero_rate FROM flagged GROUP BY broadcast")
register("broadcast_gap_settled", lambda t: authors.broadcast_gap(flagged(t), hours=168), f"WITH {FLAGGED_SQL} SELECT broadcast, count(*) AS posts, round(avg(like_count + repost_count), 6) AS mean_engagement, round(avg(CAST(like_count + repost_count = 0 AS INTEGER)), 6) AS zero_rate FROM flagged WHERE collected_at - published_at > INTERVAL 168 HOUR GROUP BY broadcast")
register("actor_composition", lambda t: authors.actor_composition(flagged(t)), f"""WITH {FLAGGED_SQL}, c AS (SELECT topic, count(*) AS posts, count(*) FILTER (broadcast) AS broadcast_posts, count(DISTINCT author_id) AS authors, count(DISTINCT author_id) FILTER (broadcast) AS broadcast_authors FROM flagged GROUP BY topic)
      SELECT *, round_even(broadcast_posts / posts, 4) AS share, CASE WHEN broadcast_posts / posts >= 0.5 THEN 'mostly broadcast' WHEN broadcast_posts / posts >= 0.2 THEN 'mixed' ELSE 'mostly organic' END AS reading FROM c""")
register("measure_audience", lambda t: authors.measure_audience(t.posts), f"WITH {AUDIENCE_SQL} SELECT * FROM audience")
register("profile_tier", lambda t: authors.measure_audience(t.posts).groupBy(authors.profile_tier(F.col("n_posts")).alias("tier")).agg(F.count(F.lit(1)).alias("authors")), f"WITH {PROFILES_SQL} SELECT tier, count(*) AS authors FROM prof GROUP BY tier")
register("build_profiles", profiles, f"WITH {PROFILES_SQL} SELECT * FROM prof")
register("derive_actor_type", lambda t: profiles(t).groupBy("function", "audience", "actor_type").agg(F.count(F.lit(1)).alias("authors")), f"WITH {PROFILES_SQL} SELECT function, audience, actor_type, count(*) AS authors FROM prof GROUP BY ALL")
register("profile_coverage", lambda t: authors.profile_coverage(profiles(t)), f"WITH {PROFILES_SQL} SELECT tier, CAST(sum(n_posts) AS BIGINT) AS posts, count(*) AS authors, round(coalesce(sum(n_posts) FILTER (actor_type <> 'unclassified'), 0) / sum(n_posts), 6) AS classified_share FROM prof GROUP BY tier")
_LEFT_OUT = {
    "attention": "actor_type IN ('intel_feed_raw', 'intel_feed_amplified', 'promotion_unheard', 'promotion_reaching')",
    "events": "actor_type IN ('promotion_unheard', 'promotion_reaching')",
    "all": "false",
    "ecosystem": "actor_type NOT IN ('promotion_unheard', 'promotion_reaching', 'org_reaching', 'org_unheard')",
}
for _mode, _cond in _LEFT_OUT.items():
    register(f"actor_mode_exclusion_{_mode}", lambda t, m=_mode: authors.mode_exclusion(profiles(t), m), f"WITH {PROFILES_SQL} SELECT author_id, actor_type FROM prof WHERE {_cond}")
register("author_strata", lambda t: authors.author_strata(t.posts), """WITH s AS (SELECT author_id, count(*) AS n, round(avg(coalesce(like_count, 0) + coalesce(repost_count, 0)), 6) AS mean_engagement FROM posts GROUP BY author_id)
      SELECT *, CASE WHEN n >= 50 AND mean_engagement < 0.5 THEN 'feed' ELSE 'other' END AS stratum FROM s""")
register("author_text_sample", lambda t: authors.author_text_sample(t.posts), r"""WITH s AS (SELECT author_id, post_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM posts),
      r AS (SELECT author_id, post_id, substr(x, 1, 280) AS sample, row_number() OVER (PARTITION BY author_id ORDER BY length(x) DESC, post_id) AS place FROM s) SELECT author_id, post_id, place, sample FROM r WHERE place <= 8""")
register(
    "author_distribution",
    lambda t: interaction.concentration(t.relevant.groupBy("topic", "author_id").agg(F.count(F.lit(1)).alias("n")), "topic", "n"),
    """WITH a AS (SELECT topic, author_id, count(*) AS n FROM relevant GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC) AS place FROM a)
      SELECT topic, count(*) AS actors, CAST(sum(n) AS BIGINT) AS total, round(sum(n * n) / (sum(n) * sum(n)), 6) AS hhi, round(sum(n) FILTER (place <= 1) / sum(n), 6) AS top_1,
        round(sum(n) FILTER (place <= 5) / sum(n), 6) AS top_5, round(sum(n) FILTER (place <= 10) / sum(n), 6) AS top_10 FROM s GROUP BY topic""",
)
register("informative_users", lambda t: metrics.informative_users(t.relevant.withColumn("followers", F.substring("author_id", 2, 20).cast("long") * 10)), """WITH d AS (SELECT author_id, CAST(published_at AS DATE) AS day, count(*) AS posts, count(*) FILTER (topic = 'error') AS event_posts FROM relevant GROUP BY ALL),
      m AS (SELECT author_id, avg(event_posts / posts) AS mean_share FROM d GROUP BY author_id) SELECT author_id, round(mean_share, 6) AS mean_share, round(mean_share * ln(CAST(substr(author_id, 2) AS BIGINT) * 10 + 1), 6) AS score FROM m""")

# null model: the shift of (iteration, author) is a hash, so the SQL twin repeats every draw
_WORD = lambda text, k: f"CAST('0x' || substr(md5({text}), {8 * k + 1}, 8) AS BIGINT) % {nullmodel.PRIME}"
_SHIFT = f"(((ka * h + kb) % {nullmodel.PRIME} * h + kc) % {nullmodel.PRIME} * h + kd) % {nullmodel.PRIME} % 14"
_CELLS = f"""cells AS (SELECT topic, author_id, CAST(floor(date_diff('second', TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY, published_at) / 86400) AS BIGINT) AS day, count(*) AS n
      FROM relevant WHERE ({_CUR}) OR ({_PREV}) GROUP BY ALL), iters AS (SELECT iteration, {', '.join(f'{_WORD(chr(39) + "iteration:" + chr(39) + " || iteration", k)} AS k{c}' for k, c in enumerate('abcd'))} FROM (SELECT unnest(range(0, 40)) AS iteration)),
    hashed AS (SELECT *, {_WORD("author_id || '#1'", 0)} AS h FROM cells),
    drawn AS (SELECT iteration, topic, CAST(sum(CASE WHEN (day + {_SHIFT}) % 14 >= 7 THEN n ELSE -n END) AS BIGINT) AS delta FROM hashed, iters GROUP BY ALL)"""
register("null_author_shift", lambda t: nullmodel.author_shift(t.relevant, AS_OF, W, 40), f"WITH {_CELLS} SELECT * FROM drawn")
register("null_summary", lambda t: nullmodel.summary(nullmodel.observed(t.relevant, AS_OF, W), nullmodel.author_shift(t.relevant, AS_OF, W, 40)), f"""WITH {_CELLS}, obs AS (SELECT topic, CAST(sum(CASE WHEN day >= 7 THEN n ELSE -n END) AS BIGINT) AS delta FROM cells GROUP BY topic),
      mx AS (SELECT iteration, max(abs(delta)) AS m FROM drawn GROUP BY iteration), p95 AS (SELECT quantile_cont(m, 0.95) AS max_null_p95 FROM mx),
      s AS (SELECT o.topic, o.delta AS observed, round(avg(d.delta), 6) AS null_mean, round(stddev_samp(d.delta), 6) AS null_sd, round(quantile_cont(abs(d.delta), 0.95), 6) AS null_p95,
        round((count(*) FILTER (abs(d.delta) >= abs(o.delta)) + 1) / (count(*) + 1), 6) AS p_raw FROM obs o JOIN drawn d USING (topic) GROUP BY o.topic, o.delta),
      f AS (SELECT o.topic, round((count(*) FILTER (m >= abs(o.delta)) + 1) / (count(*) + 1), 6) AS p_fwer FROM obs o, mx GROUP BY o.topic)
      SELECT s.*, p_fwer, round(max_null_p95, 6) AS max_null_p95, CASE WHEN p_fwer <= 0.05 THEN 'signal' WHEN p_raw <= 0.05 THEN 'weak' ELSE 'noise' END AS verdict FROM s JOIN f USING (topic), p95""")
# the whole tests, without twins as SQL is too slow; the two above repeat the first 40 draws in SQL
DRAWS = 2000
register("null_author_shift_2000", lambda t: nullmodel.author_shift(t.relevant, AS_OF, W, DRAWS))
register("null_summary_2000", lambda t: nullmodel.summary(nullmodel.observed(t.relevant, AS_OF, W), nullmodel.author_shift(t.relevant, AS_OF, W, DRAWS)))
register("null_post_perm", lambda t: nullmodel.post_permutation(t.relevant, AS_OF, W, DRAWS))
register("power_scale", lambda t: nullmodel.power_scale(t.relevant, AS_OF, W, DRAWS, (1, 2, 4, 8, 16)))

# daily series
_DAILY = "td AS (SELECT topic, CAST(published_at AS DATE) AS day, count(*) AS n FROM relevant GROUP BY ALL), span AS (SELECT min(day) AS a, max(day) AS b FROM td), grid AS (SELECT topic, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT topic FROM td), span), filled AS (SELECT topic, day, coalesce(n, 0) AS n FROM grid LEFT JOIN td USING (topic, day))"
_W = "WINDOW w AS (PARTITION BY topic ORDER BY day)"
daily = lambda t: metrics.filled_daily(t.relevant)
register("moving_average", lambda t: metrics.moving_average(daily(t), 3), f"WITH {_DAILY} SELECT topic, day, n, round(avg(n) OVER (PARTITION BY topic ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM filled")
register("acceleration", lambda t: metrics.acceleration(daily(t)), f"WITH {_DAILY} SELECT topic, day, n - 2 * lag(n) OVER w + lag(n, 2) OVER w AS acceleration FROM filled {_W}")
register("volatility", lambda t: metrics.volatility(daily(t)), f"WITH {_DAILY} SELECT topic, round(stddev_samp(n) / avg(n), 6) AS volatility FROM filled GROUP BY topic")
register("zscore", lambda t: metrics.zscore(daily(t), 7), f"WITH {_DAILY}, h AS (SELECT topic, day, n, avg(n) OVER x AS m, stddev_samp(n) OVER x AS s, count(*) OVER x AS c FROM filled WINDOW x AS (PARTITION BY topic ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) SELECT topic, day, CASE WHEN c = 7 AND s > 0 THEN round((n - m) / s, 6) END AS z FROM h")
register("novelty", lambda t: metrics.novelty(t.relevant, AS_OF, W), f"SELECT topic, min(published_at) AS first_seen, max(published_at) AS last_seen, bool_or(published_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS in_baseline FROM relevant GROUP BY topic")
register("persistence", lambda t: metrics.persistence(daily(t), 40), f"WITH {_DAILY}, r AS (SELECT topic, day, day - CAST(row_number() OVER (PARTITION BY topic ORDER BY day) AS INTEGER) AS island FROM filled WHERE n >= 40), l AS (SELECT topic, island, count(*) AS run FROM r GROUP BY ALL) SELECT topic, max(run) AS longest FROM l GROUP BY topic")
register("recurrence", lambda t: metrics.recurrence(t.relevant, 2), "WITH d AS (SELECT DISTINCT author_id, CAST(published_at AS DATE) AS day FROM relevant), g AS (SELECT author_id, day, day - lag(day) OVER (PARTITION BY author_id ORDER BY day) - 1 AS gap FROM d) SELECT author_id, count(*) FILTER (gap >= 2) AS returns, CAST(max(gap) AS INTEGER) AS longest_gap FROM g GROUP BY author_id")
register("engagement_median", lambda t: metrics.engagement_median(t.relevant), "SELECT topic, CAST(sum(like_count + repost_count) AS BIGINT) AS total, CAST(quantile_cont(like_count + repost_count, 0.5) AS DOUBLE) AS median FROM relevant GROUP BY topic")
register("candidate_rule", lambda t: metrics.candidate_rule(trend.trend_compare(t.relevant, AS_OF, W), 5, 0.0, 3), f"""WITH {_compare_sql('relevant')} SELECT topic, n_cur, rel_growth, authors_cur, n_cur >= 5 AND coalesce(rel_growth > 0, true) AND authors_cur >= 3 AS emerging,
      array_to_string(list_filter([CASE WHEN n_cur >= 5 THEN 'volume' END, CASE WHEN coalesce(rel_growth > 0, true) THEN 'growth' END, CASE WHEN authors_cur >= 3 THEN 'authors' END], lambda x: x IS NOT NULL), ',') AS reasons FROM compared""")
