"""Clusters of posts by entity, time, quote and repost."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubbub.operators import clusters as c
from hubbub.plans.catalog import register
from hubbub.plans.language import mentions
from hubbub.plans.verdicts import _CH

GAP = 3
#: post_clusters and cluster_effective_n link by the quotes and reposts of these seeds only, cluster_by_entity_time by all.
SOME_SEEDS = " AND seed_id % 3 = 0"


def shares(t, seeds=""):
    return t.edges.where(f"edge_type IN ('quote', 'repost'){seeds}").select(F.col("edge_no").alias("post_id"), F.col("target_id").alias("of"))


def clustered(t, named=None, seeds=SOME_SEEDS):
    return c.post_clusters(t.posts, named or staged_mentions(t), shares(t, seeds), GAP)


def staged_mentions(t):
    """Read several times, so the texts are searched once."""
    return c.staged(mentions(t), "mentions")


def described(t):
    named = staged_mentions(t)
    return c.describe_clusters(c.staged(clustered(t, named, seeds=""), "clusters"), t.posts, named)


def effective(t):
    named = staged_mentions(t)
    own = c.staged(clustered(t, named), "clusters")
    return c.effective_counts(c.describe_clusters(own, t.posts, named), own, t.relevant)


# runs by the gap to the post before; clusters by walking all links
def _runs(seeds):
    return f"""{_CH},
    m AS (SELECT DISTINCT e.post_id, lower(entity) AS entity, author_id, published_at FROM ch e JOIN posts p ON p.post_id = e.post_id WHERE fault IS NULL),
    g AS (SELECT *, coalesce(published_at > lag(published_at) OVER o + INTERVAL {GAP} HOUR, true) AS far FROM m WINDOW o AS (PARTITION BY entity ORDER BY published_at, post_id)),
    r AS (SELECT *, sum(CAST(far AS INTEGER)) OVER (PARTITION BY entity ORDER BY published_at, post_id) AS run FROM g),
    hub AS (SELECT post_id AS u, min(post_id) OVER (PARTITION BY entity, run) AS v FROM r),
    lk AS (SELECT u, v FROM hub UNION SELECT edge_no, target_id FROM edges WHERE edge_type IN ('quote', 'repost'){seeds}
           AND edge_no IN (SELECT post_id FROM posts) AND target_id IN (SELECT post_id FROM posts)),
    bo AS (SELECT u, v FROM lk WHERE u <> v UNION SELECT v, u FROM lk WHERE u <> v),
    walk AS (SELECT post_id AS a, post_id AS b FROM posts UNION SELECT w.a, bo.v FROM walk w JOIN bo ON bo.u = w.b),
    cl AS (SELECT a AS post_id, min(b) AS cluster_id FROM walk GROUP BY a)"""


def _described(seeds):
    return f"""{_runs(seeds)},
    n AS (SELECT cluster_id, count(DISTINCT entity) AS entities FROM cl JOIN m USING (post_id) GROUP BY 1),
    d AS (SELECT cluster_id, count(*) AS posts, count(DISTINCT author_id) AS authors, min(published_at) AS first_at, max(published_at) AS last_at FROM cl JOIN posts USING (post_id) GROUP BY 1),
    de AS (SELECT cluster_id, posts, authors, coalesce(entities, 0) AS entities, first_at, last_at, round(authors / posts, 6) AS score, authors / posts >= 0.8 AS many_voices
           FROM d LEFT JOIN n USING (cluster_id))"""


register("post_clusters", clustered, f"WITH {_runs(SOME_SEEDS)} SELECT post_id, cluster_id FROM cl")
register("cluster_by_entity_time", described, f"WITH {_described('')} SELECT * FROM de")
register(
    "cluster_effective_n", effective,
    f"""WITH {_described(SOME_SEEDS)}, x AS (SELECT topic, cluster_id, count(*) AS n FROM relevant JOIN cl USING (post_id) GROUP BY ALL)
      SELECT topic, CAST(sum(n) AS BIGINT) AS posts, count(*) AS clusters, count(*) FILTER (many_voices) AS many_voices FROM x JOIN de USING (cluster_id) GROUP BY 1""",
)
