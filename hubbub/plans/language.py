"""Phrases, co-occurring words, centroids and entity runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubbub.operators import language as g
from hubbub.plans.adapters import AS_OF
from hubbub.plans.catalog import register
from hubbub.plans.verdicts import _CH, valid

_TK = f"""tk AS (SELECT post_id, published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS now, regexp_extract_all(regexp_replace(lower(text), 'https?://[^\\s]+', ' ', 'g'), '[a-z0-9]+') AS w
      FROM posts WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND published_at < TIMESTAMP '{AS_OF}')"""
register("phrase_trend", lambda t: g.phrase_trend(t.posts, AS_OF, 7), f"""WITH {_TK}, ph AS (SELECT DISTINCT post_id, now, w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT *, unnest(range(1, len(w))) AS i FROM tk)),
      n AS (SELECT count(*) FILTER (now) AS n_now, count(*) FILTER (NOT now) AS n_before FROM tk), c AS (SELECT phrase, count(*) FILTER (now) AS cur, count(*) FILTER (NOT now) AS prev FROM ph GROUP BY 1 HAVING cur >= 3)
      SELECT phrase, cur, prev, round((cur + 1) / (n_now + 1) / ((prev + 1) / (n_before + 1)), 6) AS lift FROM c, n""")
register("cooccurrence_shift", lambda t: g.cooccurrence_shift(t.posts, ["breach", "campaign", "vulnerability"], AS_OF, 7), f"""WITH {_TK}, x AS (SELECT DISTINCT post_id, CASE WHEN now THEN 'cur' ELSE 'prev' END AS period, w, unnest(w) AS target FROM tk), y AS (SELECT DISTINCT post_id, period, target, unnest(w) AS word FROM x WHERE target IN ('breach', 'campaign', 'vulnerability')),
      z AS (SELECT period, target, word, count(*) AS posts FROM y WHERE word <> target GROUP BY 1, 2, 3) SELECT *, CAST(row_number() OVER (PARTITION BY period, target ORDER BY posts DESC, word) AS INTEGER) AS place FROM z QUALIFY place <= 10""")
register("centroid_shift", lambda t: g.centroid_shift(t.embeddings, "label", F.col("vec_id") % 2 == 0), """WITH v AS (SELECT label, vec_id % 2 = 0 AS later, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL)) = 0),
      m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) FILTER (later) AS a, avg(CAST(x AS DOUBLE)) FILTER (NOT later) AS b FROM v GROUP BY 1, 2) SELECT label, round(1 - sum(a * b) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0), 6) AS shift FROM m GROUP BY 1""")


def mentions(t):
    return valid(t).select("post_id", F.lower("entity").alias("entity")).distinct().join(t.posts.select("post_id", "author_id", "published_at"), "post_id")


register("entity_sessions", lambda t: g.entity_sessions(mentions(t), 3), f"""WITH {_CH}, d AS (SELECT DISTINCT post_id, lower(entity) AS entity FROM ch WHERE fault IS NULL), m AS (SELECT entity, author_id, published_at, CAST(published_at AS DATE) AS day FROM d JOIN posts USING (post_id)),
      g AS (SELECT entity, day, min(published_at) AS a, max(published_at) AS b FROM m GROUP BY 1, 2), h AS (SELECT *, coalesce(a > lag(b) OVER (PARTITION BY entity ORDER BY day) + INTERVAL 3 HOUR, false) AS far FROM g), r AS (SELECT entity, day, CAST(sum(CAST(far AS INTEGER)) OVER (PARTITION BY entity ORDER BY day) AS BIGINT) AS run FROM h)
      SELECT entity, run, min(published_at) AS first_at, max(published_at) AS last_at, count(*) AS posts, count(DISTINCT author_id) AS authors, round(count(DISTINCT author_id) / count(*), 6) AS score, count(DISTINCT author_id) / count(*) >= 0.8 AS many_voices FROM m JOIN r USING (entity, day) GROUP BY 1, 2""")
register("cluster_broadcast_score", lambda t: t.relevant.groupBy("topic").agg(F.round(F.countDistinct("author_id") / F.count(F.lit(1)), 6).alias("score"), (F.countDistinct("author_id") / F.count(F.lit(1)) >= 0.8).alias("many_voices")),
      "SELECT topic, round(count(DISTINCT author_id) / count(*), 6) AS score, count(DISTINCT author_id) / count(*) >= 0.8 AS many_voices FROM relevant GROUP BY 1")
