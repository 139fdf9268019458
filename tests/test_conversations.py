"""Populations, groups, people in roles, gaps, delays and sensors by hand-made seeds."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hubbub.operators import conversations as c

NOON = datetime(2024, 1, 1, 12)
FACT = "seed_id long, author_id string, topic_key string, kind string, status string, d1 long, d2 long, quotes long, reposts long, reply_count long, quote_count long, in_main boolean, created_at timestamp"
EDGE = "seed_id long, actor string, edge_type string, depth int, event_time timestamp"


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        (1, "a", "t", "x", "observed", 2, 1, 0, 1, 1, None, True, NOON), (2, "a", "t", None, "observed", 0, 0, 1, 0, 0, 3, False, NOON), (3, "b", "u", "x", "observed", 0, 0, 0, 1, None, 0, True, NOON),
        (4, "c", None, "y", "failed", 0, 0, 0, 0, 5, 5, True, NOON), (5, "d", "u", "y", "missing", 0, 0, 0, 0, 0, 0, None, NOON),
    ]
    df = spark.createDataFrame(rows, FACT)
    seen = F.col("status") == "observed"
    return df.withColumn("observed", seen).withColumn("conversation", seen & (F.col("d1") + F.col("quotes") > 0))


@pytest.fixture(scope="module")
def edges(spark):
    at = lambda h: None if h is None else NOON + timedelta(hours=h)
    rows = [(1, "p", "reply", 1, at(1)), (1, "q", "reply", 1, at(-2)), (1, "p", "reply", 2, at(30)), (1, "r", "repost", 1, None), (2, "a", "quote", 1, at(3)), (3, "p", "repost", 1, None), (4, "z", "reply", 1, at(1)), (1, None, "reply", 1, None)]
    return spark.createDataFrame(rows, EDGE)


@pytest.fixture(scope="module")
def roles(facts, edges):
    return c.seed_roles(facts, edges)


def test_roles_are_of_observed_seeds_and_known_people(roles):
    got = {(r.seed_id, r.actor): r.role for r in roles.collect()}
    assert got == {(1, "a"): c.AUTHOR, (1, "p"): c.REPLY | c.DEEPER, (1, "q"): c.REPLY, (1, "r"): c.REPOST, (2, "a"): c.AUTHOR | c.QUOTE, (3, "b"): c.AUTHOR, (3, "p"): c.REPOST}
    assert {tuple(r) for r in c.seed_participants(roles).collect()} == {(1, 2, 2, 0, 1, 3), (2, 0, 0, 1, 0, 1), (3, 0, 0, 0, 1, 1)}


def test_overlapping_populations(facts, roles):
    out = c.population_summary(facts, roles, {"all": F.lit(True), "main": F.col("in_main"), "none": F.lit(False)})
    got = {r.population: r for r in out.collect()}
    assert set(got) == {"all", "main"}
    r = got["all"]
    assert (r.seeds, r.observed, r.failed, r.missing, r.conversations, r.csr) == (5, 3, 1, 1, 2, 0.666667) and (r.with_d1, r.with_quotes, r.with_reposts) == (1, 1, 2)
    assert (r.depth1, r.depth2, r.quote_edges, r.repost_edges) == (2, 1, 1, 2)
    assert (r.seed_authors, r.reposters, r.participants, r.participants_no_reposts, r.actors) == (2, 2, 4, 3, 5)
    r = got["main"]
    assert (r.seeds, r.observed, r.conversations) == (3, 2, 1) and (r.seed_authors, r.reposters, r.participants, r.participants_no_reposts, r.actors) == (2, 2, 3, 2, 5)


def test_groups_in_one_pass(facts, roles):
    got = {(r.kind_, r.value): r for r in c.group_summary(facts.withColumnRenamed("kind", "sort"), roles, ["topic_key", "sort"]).withColumnRenamed("kind", "kind_").collect()}
    assert set(got) == {("all", ""), ("topic_key", "t"), ("topic_key", "u"), ("topic_key", "(none)"), ("sort", "x"), ("sort", "y"), ("sort", "(none)")}
    assert (got["topic_key", "t"].participants, got["topic_key", "t"].actors, got["topic_key", "t"].csr) == (4, 4, 1.0)
    assert (got["sort", "y"].observed, got["sort", "y"].csr, got["sort", "y"].actors) == (0, None, 0) and got["all", ""].actors == 5


def test_removing_top_authors(facts, roles):
    got = {r.removed: tuple(r)[1:] for r in c.without_top_authors(facts, roles, (0, 1, 5)).collect()}
    assert got == {0: (5, 3, 0.666667, 3, 1, 4), 1: (3, 1, 0.0, 0, 0, 1)}


def test_gaps_early_counts_and_drift(spark, facts):
    got = {r.kind: tuple(r)[1:] for r in c.count_gaps(facts, {"d1": "reply_count", "quotes": "quote_count"}).collect()}
    assert got == {"d1": (1, 2, 0), "quotes": (3, 1, 1)}
    assert {tuple(r) for r in c.early_counts(facts, ["reply_count", "quote_count"]).collect()} == {(True, True, 2), (False, False, 1)}
    strict = spark.createDataFrame([(1,), (3,), (3,)], "seed_id long")
    got = {r.topic_key: (r.seeds, r.observed, r.conversations, r.silent, r.grown, r.same, r.fallen) for r in c.strict_summary(facts, strict, "topic_key").collect()}
    assert got == {"t": (2, 1, 1, 0, 1, 0, 0), "u": (2, 1, 0, 0, 0, 1, 0), None: (1, 0, 0, 0, 0, 0, 0)}


def test_delays_keep_replies_dated_before_their_seed(facts, edges):
    r = c.reply_delays(facts, edges).first()
    assert (r.n, r.before_seed, r.mean_h, r.median_h, r.least_h, r.most_h, r.within_day, r.q1_h, r.p90_h) == (3, 1, 9.666667, 1.0, -2.0, 30.0, 0.666667, -0.5, 24.2)
    assert [tuple(r) for r in c.reply_delays(facts, edges.where("seed_id = 3")).collect()] == []


def test_distributions_and_concentration(facts, edges):
    got = {r.measure: (r.n, r.total, r["mean"], r.most, r.zero_share, r.q1, r.median, r.q3) for r in c.distributions(facts, ["d1", "reposts"]).collect()}
    assert got == {"d1": (3, 2, 0.666667, 2, 0.666667, 0.0, 0.0, 1.0), "reposts": (3, 2, 0.666667, 1, 0.333333, 0.5, 1.0, 1.0)}
    got = {r.kind: (r.actors, r.total, r.top_1) for r in c.producers(facts.where("in_main"), edges).collect()}
    assert got == {"seed_posts": (3, 3, 0.333333), "replies": (3, 4, 0.5), "reposts": (2, 2, 0.5)}


def test_sensors_count_every_role_but_reposts(spark, facts, roles):
    rows = {r.topic: tuple(r)[1:] for r in c.sensors(facts, roles).collect()}
    assert rows == {"t": (2, 3, 4, 1, 1, 1, 2.0), "u": (1, 1, 0, 2, 2, 2, 0.0)}
    vectors = spark.createDataFrame([("a", 1, 5, 2), ("b", 2, 5, 1), ("c", 3, 5, 0)], "topic string, s_post int, s_actor int, s_interaction int")
    assert {r.pair: (r.rho, r.n) for r in c.sensor_correlations(vectors).collect()} == {"s_post~s_actor": (None, 3), "s_post~s_interaction": (-1.0, 3), "s_actor~s_interaction": (None, 3)}
