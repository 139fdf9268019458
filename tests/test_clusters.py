"""Runs and clusters: gaps, shared posts, quotes, hot entities, odd rows."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from hubbub.llm.components import connected_components as corpus_components
from hubbub.operators import clusters
from hubbub.operators.components import connected_components
from hubbub.plans.clusters import described

NOON = datetime(2024, 1, 1, 12)
MENTION = "entity string, post_id long, published_at timestamp"


def mention(spark, rows):
    return spark.createDataFrame([(e, p, NOON + timedelta(minutes=m) if m is not None else None) for e, p, m in rows], MENTION)


def of_posts(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "post_id long")


def shares_of(spark, pairs):
    return spark.createDataFrame(pairs, "post_id long, of long")


def test_runs_break_at_every_gap(spark):
    rng = random.Random(2)
    rows, at = [], 0
    for p in range(300):
        at += rng.choice([1, 30, 179, 180, 181, 400])
        rows.append((rng.choice("ab"), p, at))
    got = {(r.entity, r.post_id): r.run for r in clusters.entity_runs(mention(spark, rows), 3).collect()}
    for e in "ab":
        own = [(m, p) for x, p, m in rows if x == e]
        for (m, p), (n, q) in zip(own, own[1:]):
            assert (got[e, p] == got[e, q]) == (n - m <= 180)


def test_runs_that_share_a_post_are_one_cluster(spark):
    rows = [("a", 1, 0), ("a", 2, 60), ("b", 2, 60), ("b", 3, 100), ("b", 9, 900), ("c", 4, 0), ("c", 5, 10), (None, 6, 0), ("d", 7, None), ("a", 50, 0)]
    out = clusters.post_clusters(of_posts(spark, range(1, 13)), mention(spark, rows), shares_of(spark, [(10, 9), (11, 10), (12, 99), (None, 4), (4, None)]), 3)
    assert {r.post_id: r.cluster_id for r in out.collect()} == {1: 1, 2: 1, 3: 1, 9: 9, 10: 9, 11: 9, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 12: 12}


def test_a_hot_entity_costs_a_link_a_post(spark):
    rows = [("hot", p, p % 500) for p in range(4000)]
    runs = clusters.entity_runs(mention(spark, rows), 3)
    assert clusters.run_links(runs).count() == 3999
    out = clusters.post_clusters(of_posts(spark, range(4000)), mention(spark, rows), shares_of(spark, []), 3)
    assert [tuple(r) for r in out.groupBy("cluster_id").agg(F.count("*")).collect()] == [(0, 4000)]


def test_long_chains_reach_their_end(spark):
    rng = random.Random(4)
    ids = list(range(300))
    rng.shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:])) + [(900, 901), (901, 901), (None, 5)], "u long, v long")
    got = {r.node: r.component for r in connected_components(links, max_rounds=12).collect()}
    assert got == {i: 0 for i in ids} | {900: 900, 901: 900}


def test_clusters_are_described_and_counted(spark):
    posts = spark.createDataFrame([(i, a, NOON + timedelta(hours=i)) for i, a in enumerate(["x", "x", "x", "y", None])], "post_id long, author_id string, published_at timestamp")
    own = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3), (4, 4)], "post_id long, cluster_id long")
    rows = clusters.describe_clusters(own, posts, mention(spark, [("a", 0, 0), ("b", 1, 0), ("a", 2, 0)]))
    assert sorted((r.cluster_id, r.posts, r.authors, r.entities, r.score, r.many_voices) for r in rows.collect()) == [(0, 3, 1, 2, 0.333333, False), (3, 1, 1, 0, 1.0, True), (4, 1, 0, 0, 0.0, False)]
    topics = spark.createDataFrame([(0, "t"), (1, "t"), (3, "t"), (4, "s")], "post_id long, topic string")
    assert sorted(tuple(r) for r in clusters.effective_counts(rows, own, topics).collect()) == [("s", 1, 1, 0), ("t", 3, 2, 1)]


def test_components_need_few_rounds_and_jobs(spark):
    """Chains in order, a star and pairs: in rounds alone, in rounds and a last task, and, when few edges are there, at once."""
    chain = [(i, i + 1) for i in range(1000)]
    links = chain + [(5000, i) for i in range(2000, 4000)] + [(i, i - 1) for i in range(6001, 6200, 2)]
    expected = {i: 0 for i in range(1001)} | {i: 2000 for i in [5000, *range(2000, 4000)]} | {i: i - (i % 2) for i in range(6000, 6200)}
    table = spark.createDataFrame(links, "u long, v long")
    for at_once, rounds in [(0, 30), (500, 8), (1 << 18, 0)]:
        for function in (connected_components, corpus_components):
            assert {r.node: r.component for r in function(table, max_rounds=rounds, at_once=at_once).collect()} == expected
    assert connected_components(table.where("u < 0")).count() == 0


def test_quotes_and_reposts_of_every_seed_link(spark):
    """Of seeds that 3 divides (60) and of others (20, 40, 100); replies link nothing."""
    posts = [(i, f"u{i % 2}", NOON + timedelta(days=i), "lol") for i in (20, 21, 40, 41, 42, 60, 61, 80, 81, 100, 101)]
    edges = [(21, 20, 20, "quote"), (41, 40, 40, "repost"), (42, 40, 41, "quote"), (61, 60, 60, "repost"), (81, 80, 80, "reply"), (101, 100, 100, "quote")]
    tables = SimpleNamespace(
        posts=spark.createDataFrame(posts, "post_id long, author_id string, published_at timestamp, text string"),
        edges=spark.createDataFrame(edges, "edge_no long, seed_id long, target_id long, edge_type string"),
        entities=spark.createDataFrame([], "post_id long, label_version string, entity string, kind string"),
    )
    assert {r.cluster_id: r.posts for r in described(tables).collect()} == {20: 2, 40: 3, 60: 2, 80: 1, 81: 1, 100: 2}


def test_joins_by_post_send_no_table_to_all(spark):
    """A file of ids is far smaller than the ids in memory, so its size must not decide."""
    named = mention(spark, [("a", 1, 0), ("a", 2, 60)])
    tables = [clusters.entity_runs(named, 3), clusters.post_clusters(of_posts(spark, range(3)), named, shares_of(spark, [(0, 1)]), 3)]
    for table in tables:
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
