"""Event linking: names, domains, the key filter, evaluation sets, first posts, search."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hubbub.operators import keyfilter, linking

DAY = datetime(2024, 1, 10)
ENTITY = "event_id string, canonical string, is_domain boolean, at timestamp"


def posts_of(spark, rows):
    return spark.createDataFrame([(i, f"a{i % 3}", text, DAY + timedelta(days=d) if d is not None else None) for i, (text, d) in enumerate(rows)], "post_id long, author_id string, text string, published_at timestamp")


def test_names_and_domains_match_as_wholes(spark):
    entities = spark.createDataFrame([("e1", "acme widgets", False, DAY), ("e2", "acme-widgets.co.uk", True, DAY), ("e3", "c++ users", False, DAY), ("e4", None, True, DAY), ("e5", "late works", False, None)], ENTITY)
    texts = [
        ("ACME  Widgets, Inc. hit", 0), ("xacme widgets", 0), ("acme widgetsx", 0), ("see https://www.ACME-widgets.co.uk/x", 1), ("acme-widgetsxco.uk", 0), ("acme-widgets.co.uk2", 0),
        ("shop.acme-widgets.co.uk.", -1), (None, 0), ("", 0), ("acme widgets", None), ("late works", 0), ("acme\nwidgets and acme-widgets.co.uk", 40),
    ]
    got = linking.name_matches(posts_of(spark, texts), entities)
    assert sorted(((r.post_id, r.event_id, r.delta) for r in got.collect()), key=repr) == sorted([(0, "e1", 0), (3, "e1", 1), (3, "e2", 1), (6, "e1", -1), (6, "e2", -1), (11, "e1", 40), (11, "e2", 40), (5, "e1", 0), (9, "e1", None)], key=repr)
    near = linking.name_matches(posts_of(spark, texts), entities, (2, 30))
    assert {r.post_id for r in near.collect()} == {0, 3, 5, 6}


def test_the_key_filter_admits_every_key_and_few_others(spark):
    keys = [f"k{i}" for i in range(3000)] + [None]
    bits = keyfilter.key_bits(spark.createDataFrame([(k,) for k in keys], "token string"))
    others = [f"other {i}" for i in range(3000)]
    rows = spark.createDataFrame([(keys[:-1] + others,), ([],), (None,)], "tokens array<string>").select(keyfilter.admitted(F.col("tokens"), bits).alias("kept")).collect()
    kept = set(rows[0].kept)
    assert kept >= set(keys[:-1]) and len(kept) < 3060 and rows[1].kept == [] and rows[2].kept is None
    assert keyfilter.key_bits(spark.createDataFrame([], "token string")) == bytes(keyfilter.BITS // 8)


def test_evaluation_sets(spark):
    matches = spark.createDataFrame(
        [(1, "h1", "a b", 3), (1, "h2", "a b", -3), (1, "f1", "z z", 0), (2, "h1", "a b", 31), (2, "f1", "z z", 1), (3, "f1", "z z", 99), (4, "h2", "a b", -2), (4, "h1", "a b", 2)] + [(5, f"h{i}", "a b", i) for i in range(3, 9)],
        "post_id long, event_id string, canonical string, delta long",
    )
    events = spark.createDataFrame([(f"h{i}", "CA") for i in range(9)] + [("f1", "US")], "event_id string, country string")
    posts, strata = spark.createDataFrame([(i, f"a{i % 2}") for i in range(9)], "post_id long, author_id string"), spark.createDataFrame([("a1", "feed")], "author_id string, stratum string")
    got = {r.post_id: tuple(r)[1:] for r in linking.evaluation_sets(matches, events, posts, strata, "CA").collect()}
    assert got == {
        1: ("positive", "feed", "h1", 3, "h1,h2", "a b"), 2: ("out_of_window", "other", None, None, None, "a b"), 3: ("negative", "feed", None, None, None, "z z"),
        4: ("positive", "other", "h1", 2, "h1,h2", "a b"), 5: ("positive", "feed", "h3", 3, "h3,h4,h5,h6,h7", "a b"),
    }


def test_who_was_first(spark):
    posts = spark.createDataFrame([(1, "feed", DAY + timedelta(hours=5)), (2, "x", DAY + timedelta(hours=5)), (3, "x", DAY + timedelta(hours=9)), (4, "feed", DAY - timedelta(hours=1))], "post_id long, author_id string, published_at timestamp")
    events, feeds = spark.createDataFrame([("a", DAY), ("b", DAY), ("c", DAY)], "event_id string, at timestamp"), spark.createDataFrame([("feed",)], "author_id string")
    matches = spark.createDataFrame([(2, "a"), (1, "a"), (1, "a"), (3, "b"), (4, "b")], "post_id long, event_id string")
    got = {r.event_id: tuple(r)[1:] for r in linking.first_posts(matches, events, posts, feeds).collect()}
    assert got == {"a": (2, 1, 5.0, 5.0, 5.0, "feed"), "b": (2, 4, -1.0, -1.0, 9.0, "feed")}
    only = spark.createDataFrame([(1,), (3,)], "post_id long")
    hits = linking.second_corpus_hits(events, matches, posts, only, only, feeds)
    assert sorted(tuple(r) for r in hits.collect()) == [("a", 2, 1, 1, 1, 0), ("b", 2, 1, 1, 1, 1), ("c", 0, 0, 0, 0, 0)]
    assert tuple(linking.stages_of(hits).first()) == (3, 2, 2, 1)


def test_search_by_title_entity_and_record(spark):
    events = spark.createDataFrame([(f"e{i}", f"Firm {i}", DAY + timedelta(days=i)) for i in range(20)] + [("n", "firm none", None)], "event_id string, name string, at timestamp")
    entities = spark.createDataFrame([("e3", "firm3.example")], "event_id string, entity string")
    records = spark.createDataFrame([("C-1", "flaw in FIRM 3 router", 5.0, False), ("C-2", None, 9.0, True), ("FIRM-3", "x", None, None)], "cve_id string, description string, cvss double, known_exploited boolean")
    got = linking.search_registry(events, entities, records, " firm ").collect()
    assert [r.id for r in got if r.kind == "event"] == [f"e{i}" for i in range(19, 4, -1)] and [r.id for r in got if r.kind == "record"] == ["C-1", "FIRM-3"]
    assert [r.id for r in linking.search_registry(events, entities, records, "firm3").collect()] == ["e3"]


def test_many_posts_and_entities_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    names = sorted({" ".join(rng.sample(words, 2)) for _ in range(20)})
    texts = [(" ".join(rng.choices(words, k=rng.randint(0, 12))), 0) for _ in range(150)]
    entities = spark.createDataFrame([(f"e{i}", n, False, DAY) for i, n in enumerate(names)], ENTITY)
    got = {(r.post_id, r.canonical) for r in linking.name_matches(posts_of(spark, texts), entities).collect()}
    assert got == {(i, n) for i, (t, _) in enumerate(texts) for n in names if f" {n} " in f" {t} "}
