import datetime as dt
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hubbub.operators import authors, content, descriptive, evaluation, interaction, language, metrics, nullmodel, trend, units, verdicts
from hubbub.sources import payloads
from hubbub.plans import catalog
from hubbub.streaming import ingest

AS_OF = "2026-09-20 00:00:00"


def posts(spark, rows):
    """rows: topic, author, days before as_of (may be a fraction)."""
    end = dt.datetime.fromisoformat(AS_OF)
    data = [(i, t, a, end - dt.timedelta(days=d)) for i, (t, a, d) in enumerate(rows)]
    return spark.createDataFrame(data, "post_id long, topic string, author_id string, published_at timestamp_ntz")


def test_windows_are_half_open_and_the_boundary_post_is_current(spark):
    rows = posts(spark, [("x", "a", 7.0), ("x", "a", 14.0), ("x", "a", 0.0), ("x", "b", 14.1)])
    row = trend.trend_compare(rows, AS_OF, 7).first()
    assert (row.n_cur, row.n_prev) == (1, 1)


def test_growth_is_null_without_a_past_and_sorts_last(spark):
    rows = posts(spark, [("new", "a", 1)] * 5 + [("old", "b", 1)] * 10 + [("old", "b", 8)] * 5)
    ranked = {r.topic: r for r in trend.trend_rank(trend.trend_compare(rows, AS_OF, 7)).collect()}
    assert ranked["new"].rel_growth is None and ranked["old"].rank == 1 and ranked["new"].rank == 2


def test_ties_rank_by_topic_descending(spark):
    rows = posts(spark, [(t, "a", d) for t in "ab" for d in (1, 2, 3, 4, 5, 8)])
    ranked = trend.trend_rank(trend.trend_compare(rows, AS_OF, 7)).orderBy("rank").collect()
    assert [r.topic for r in ranked] == ["b", "a"]


def test_other_zones_are_rejected():
    with pytest.raises(ValueError):
        trend.instant("2026-09-20 00:00:00+02:00")


def test_empty_exclusion_excludes_nobody(spark):
    rows = posts(spark, [("x", "a", 1)])
    none = spark.createDataFrame([], "author_id string")
    assert trend.exclude_authors(rows, none).count() == trend.exclude_authors(rows, None).count() == 1


def test_nothing_settled_is_unknown_and_no_broadcast(spark):
    t = dt.datetime(2026, 9, 1)
    data = [("a", t + dt.timedelta(days=i), t + dt.timedelta(days=i, hours=1), 0, 0) for i in range(9)]
    rows = spark.createDataFrame(data, "author_id string, published_at timestamp_ntz, collected_at timestamp_ntz, like_count int, repost_count int")
    activity = authors.author_activity(rows)
    assert activity.first().zero_rate is None
    assert authors.broadcast_authors(activity).count() == 0
    assert authors.measure_audience(rows).first().audience == "unknown"


def test_missing_counts_leave_averages_but_are_zero_in_strata(spark):
    t = dt.datetime(2026, 9, 1)
    data = [("a", t, t + dt.timedelta(days=2), 4, 0), ("a", t, t + dt.timedelta(days=2), 9, None)]
    rows = spark.createDataFrame(data, "author_id string, published_at timestamp_ntz, collected_at timestamp_ntz, like_count int, repost_count int")
    assert authors.author_activity(rows).first().avg_engagement == 4
    assert authors.author_strata(rows).first().mean_engagement == 6.5


def test_modes_leave_out_what_each_question_is_not_about(spark):
    kinds = [None, "unclassified", "intel_feed_raw", "intel_feed_amplified", "promotion_unheard", "promotion_reaching", "org_reaching", "news_syndicated", "organic_attention"]
    rows = spark.createDataFrame([(str(i), k) for i, k in enumerate(kinds)], "author_id string, actor_type string")
    out = {m: {int(r.author_id) for r in authors.mode_exclusion(rows, m).collect()} for m in ("attention", "events", "all", "ecosystem")}
    assert out == {"attention": {2, 3, 4, 5}, "events": {4, 5}, "all": set(), "ecosystem": {0, 1, 2, 3, 7, 8}}
    with pytest.raises(ValueError):
        authors.mode_exclusion(rows, "other")


def test_actor_types(spark):
    rows = [
        ("incident_feed", "engaged", 5, "intel_feed_amplified"), ("incident_feed", "unheard", 3, "intel_feed_raw"), ("incident_feed", "unheard", 2, "unclassified"), ("promotion", "engaged", 2, "unclassified"),
        ("incident_feed", "unknown", 9, "unclassified"), ("unknown", "engaged", 9, "unclassified"), (None, "engaged", 9, "unclassified"), ("individual", "unknown", 9, "unclassified"),
        ("promotion", "unheard", 3, "promotion_unheard"), ("news_media", "engaged", 1, "news_with_reach"), ("individual", "unheard", 1, "individual_unheard"), ("org_other", "engaged", 1, "org_reaching"),
    ]
    found = spark.createDataFrame(rows, "f string, a string, n long, want string").select("want", authors.derive_actor_type(F.col("f"), F.col("a"), F.col("n")).alias("got"))
    assert all(r.want == r.got for r in found.collect())


def test_only_edges_of_the_adopted_run_count(spark):
    latest = spark.createDataFrame([(1, "thread", 2), (1, "quotes", 0), (2, "thread", 0)], "seed_id long, endpoint string, run_id long")
    edges = spark.createDataFrame([(1, r, "a", "reply", 1) for r in (0, 1, 2)] + [(2, 1, "a", "reply", 1), (3, 0, "a", "reply", 1)], "seed_id long, run_id long, actor string, edge_type string, depth int")
    assert [(r.seed_id, r.d1) for r in interaction.seed_metrics(interaction.adopted_edges(edges, latest)).collect()] == [(1, 1)]


def test_p_values_are_never_zero_and_fwer_is_no_smaller(spark):
    rows = posts(spark, [("x", f"a{i}", 1 + i % 5) for i in range(40)] + [("y", f"b{i}", i % 14) for i in range(40)])
    drawn = nullmodel.author_shift(rows, AS_OF, 7, 50)
    out = nullmodel.summary(nullmodel.observed(rows, AS_OF, 7), drawn).collect()
    assert all(r.p_raw >= 1 / 51 - 1e-6 and r.p_fwer >= r.p_raw for r in out)
    again = nullmodel.author_shift(rows.repartition(13), AS_OF, 7, 50)
    assert drawn.exceptAll(again).count() == 0


def test_registered_tests_make_all_draws_in_many_tasks(spark):
    sf_dir = "/root/testdata/sf0.001"
    whole, first = (catalog.QUERIES[name](spark, sf_dir) for name in ("null_author_shift_2000", "null_author_shift"))
    posted = catalog.QUERIES["null_post_perm"](spark, sf_dir)
    assert whole.select("iteration").distinct().count() == posted.select("iteration").distinct().count() == 2000
    assert posted.select(F.spark_partition_id()).distinct().count() > 1
    assert whole.where("iteration < 40").exceptAll(first).count() == first.exceptAll(whole).count() == 0
    assert min(r.p_raw for r in catalog.QUERIES["null_summary_2000"](spark, sf_dir).collect()) < 1
    assert {r.scale for r in catalog.QUERIES["power_scale"](spark, sf_dir).collect()} == {1, 2, 4, 8, 16}


def test_post_permutation_is_blind_on_one_topic(spark):
    rows = posts(spark, [("x", "a", 1)] * 6 + [("x", "a", 9)] * 2)
    assert {r.delta for r in nullmodel.post_permutation(rows, AS_OF, 7, 10).collect()} == {4}


def test_centred_mean_is_null_at_the_edges_and_counts_missing_days(spark):
    daily = metrics.filled_daily(posts(spark, [("x", "a", 1), ("x", "a", 5)]))
    out = [r.rolling for r in metrics.rolling_centered(daily, 3).orderBy("day").collect()]
    assert out[0] is None and out[-1] is None and out[1] == pytest.approx(1 / 3, abs=1e-6)


def test_gini_of_equal_counts_is_zero(spark):
    counts = spark.createDataFrame([("x", 3)] * 5 + [("y", 1), ("y", 0), ("y", 9)], "topic string, n long")
    out = {r.topic: r.gini for r in descriptive.lorenz_gini(counts, "topic").collect()}
    assert out["x"] == 0 and out["y"] == pytest.approx(0.4)


@pytest.mark.parametrize(
    ("text", "found"),
    [("see CVE-2024-1234 and cve-2024-1234", [("CVE-2024-1234", 4)]), ("CVE-2024-12345678", []), ("xCVE-2024-1234", []), ("(cve-2020-99999)", [("CVE-2020-99999", 1)])],
)
def test_cve_identifiers(spark, text, found):
    rows = spark.createDataFrame([(1, text)], "post_id long, text string")
    assert [(r.cve_id, r.char_start) for r in content.extract_cves(rows).collect()] == found


def test_records_grow_with_the_parts(spark):
    for sf in ("sf0.001", "sf0.01"):
        parts = spark.read.parquet(f"/root/testdata/{sf}/part.parquet").count()
        assert catalog.QUERIES["lookup_cve"](spark, f"/root/testdata/{sf}").count() == parts
        assert catalog.QUERIES["merge_kev"](spark, f"/root/testdata/{sf}").where("cvss is not null").count() == parts


def test_post_times(spark):
    texts = ["2026-09-01T10:00:00Z", "2026-09-01T10:00:00.123456789Z", "2026-09-01T12:00:00+02:00", "2026-09-01T10:00:00", "Tue, 01 Sep 2026 10:00:00 +0000", "soon"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(content.parse_post_time(F.col("t")).alias("x")).collect()
    assert [None if r.x is None else (r.x.hour, r.x.microsecond) for r in rows] == [(10, 0), (10, 123456), (10, 0), (10, 0), (10, 0), None]


def test_upserting_twice_adds_nothing(spark):
    batch = spark.createDataFrame([("s", "1", 1), ("s", "1", 2), ("s", "2", 3)], "source_key string, source_post_id string, n long")
    keys = ["source_key", "source_post_id"]
    first = content.upsert_posts(batch.limit(0), batch, keys, "n")
    assert sorted(r.n for r in first.collect()) == [1, 3]
    assert content.upsert_posts(first, batch, keys, "n").count() == 0


def test_top_shares_of_tied_counts_do_not_depend_on_their_order(spark):
    rows = spark.createDataFrame([("x", f"a{i}", 2) for i in range(12)] + [("y", "b", 3)], "kind string, actor string, n long")
    found = {r.kind: r for r in interaction.concentration(rows, "kind", "n").collect()}
    assert (found["x"].actors, found["x"].total, found["x"].top_1, found["x"].top_5, found["x"].top_10) == (12, 24, 0.083333, 0.416667, 0.833333)
    assert found["y"].hhi == found["y"].top_1 == found["y"].top_10 == 1.0


def test_missing_seeds_are_neither_observed_nor_silent(spark):
    seeds = spark.createDataFrame([(1,), (2,), (3,)], "seed_id long")
    status = spark.createDataFrame([(1, "observed"), (2, "failed")], "seed_id long, status string")
    counts = spark.createDataFrame([(1, 0, 4, 0, 2, 3), (2, 5, 0, 0, 0, 1)], "seed_id long, d1 long, d2 long, quotes long, reposts long, actors long")
    found = {r.seed_id: (r.status, r.observed, r.conversation) for r in interaction.seed_facts(seeds, status, counts).collect()}
    assert found == {1: ("observed", True, False), 2: ("failed", False, False), 3: ("missing", False, False)}


def test_rank_test_needs_five_on_each_side(spark):
    few = spark.createDataFrame([(True, float(i)) for i in range(4)] + [(False, 1.0)] * 9, "side boolean, x double")
    assert evaluation.mann_whitney(few, "side", "x").count() == 0
    apart = spark.createDataFrame([(True, 9.0)] * 5 + [(False, 1.0)] * 6 + [(True, None)], "side boolean, x double")
    found = evaluation.mann_whitney(apart, "side", "x").first()
    assert (found.n_a, found.n_b, found.u, found.effect) == (5, 6, 30.0, -1.0) and abs(found.p - 0.002235) < 2e-6


def test_broken_answers_are_errors_and_never_guessed(spark):
    said = ['{"topic": "view"}', 'well "topic": "view" so', '{"topic": "sports"}', "no json", "", None]
    rows = spark.createDataFrame(list(enumerate(said)), "post_id long, answer string")
    found = [(r.topic, r.confidence, r.error) for r in verdicts.parse_verdict(rows, ["view"]).orderBy("post_id").collect()]
    assert found == [("view", "low", None)] * 2 + [(None, "low", "unknown_topic")] + [(None, "low", "no_topic")] * 3


def test_entities_stand_only_with_their_text_and_suffix(spark):
    posts = spark.createDataFrame([(1, "Fire at ACME.org today"), (2, None)], "post_id long, text string")
    rows = [(1, "v", "acme.org", "domain"), (1, "v", "Fire", "place"), (1, "v", "Flood", "place"), (2, "v", "Fire", "place")]
    entities = spark.createDataFrame(rows, "post_id long, label_version string, entity string, kind string")
    found = {(r.post_id, r.entity): r.fault for r in verdicts.validate_entities(entities, posts, ".org").collect()}
    assert found == {(1, "acme.org"): None, (1, "Fire"): None, (1, "Flood"): "not_in_text", (2, "Fire"): "not_in_text"}
    assert {r.entity: r.offset for r in verdicts.post_entities(entities.where("post_id = 1"), posts).collect()} == {"acme.org": 8, "Fire": 0, "Flood": -1}


def test_phrases_of_empty_null_and_one_word_texts(spark):
    rows = spark.createDataFrame([("",), (None,), ("one",), ("one two one two",)], "text string").select(language.words(F.col("text")).alias("w"))
    assert [r[0] or [] for r in rows.select(F.array_distinct(language.ngrams("w", 2))).collect()] == [[], [], [], ["one two", "two one"]]


def test_streams_resume_without_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-02 00:00:00")], "id long, t string").selectExpr("id", "CAST(t AS timestamp) AS published_at")
    for more in (rows, rows.selectExpr("id + 1 AS id", "published_at")):
        more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["id"], str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_backfills_keep_all_rows_of_many_files_in_any_order_of_time(spark, tmp_path):
    rows = pq.read_table("/root/testdata/sf0.001/events.parquet").sort_by([("ts", "descending")])
    (tmp_path / "events.parquet").mkdir()
    step = len(rows) // 300
    for i, at in enumerate(range(0, len(rows), step)):  # over 200 files are three batches, and the newest rows come first
        path = tmp_path / "events.parquet" / f"{i:03}.parquet"
        pq.write_table(rows.slice(at, step), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    assert i > 200
    out = lambda name: catalog.QUERIES[name](spark, str(tmp_path))
    assert out("stream_ingest").count() == out("stream_ingest").select("event_id").distinct().count() == len(rows)
    for name, times in (("stream_late_repair", 1), ("stream_topic_windows", 1), ("stream_sliding_windows", 2)):
        assert out(name).agg(F.sum("n")).first()[0] == times * len(rows)


def test_bodies_that_are_not_json_give_no_rows(spark):
    bodies = spark.createDataFrame([("<html>",), (None,), ('{"posts": []}',), ('{"thread": {"post": {"uri": "a"}}}',)], "body string")
    assert payloads.search_posts(bodies, "body").count() == payloads.thread_edges(bodies, "body").count() == 0


def test_unclear_units_count_for_neither_side(spark):
    rows = spark.createDataFrame([("automated_feed", "substantive_reply"), ("news_media", "substantive_reply"), (None, "information_seeking"), ("news_media", "unclear"), ("x", None)], "role string, function string")
    found = [(r.signal, r.person_signal) for r in units.human_signal(rows).collect()]
    assert found == [(0, 0), (1, None), (1, 1), (None, None), (None, None)]


def test_records_without_metrics_have_no_score(spark):
    bodies = ["no json", None, "{}", '{"metrics": {"cvssMetricV31": [], "cvssMetricV2": [{"cvssData": {"baseScore": 5.0}, "baseSeverity": "MEDIUM"}]}}']
    rows = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    assert [(r.version, r.score, r.severity) for r in units.best_cvss(rows, "body").orderBy("id").collect()] == [(None, None, None)] * 3 + [("2.0", 5.0, "MEDIUM")]


def test_outcomes_follow_the_last_page_read(spark):
    rows = [
        (1, 1, "quotes", 1, True, None, False, ["a", "b"]), (1, 1, "quotes", 2, True, None, False, ["a", "c"]),
        (1, 2, "quotes", 1, True, None, False, ["a", "a"]), (1, 2, "quotes", 2, False, "server_error", False, []),
        (1, 3, "quotes", 1, False, "not_found", False, []), (1, 4, "quotes", 1, False, "timeout", False, []),
        (1, 5, "quotes", 1, True, None, True, ["x"]), (1, 6, "quotes", 1, True, None, False, []),
    ]
    pages = spark.createDataFrame(rows, "run_id int, seed_id int, endpoint string, page int, ok boolean, error string, capped boolean, items array<string>")
    got = {r.seed_id: (r.pages, r.outcome, r["items"], r.duplicates, r.cap_hit) for r in interaction.page_outcomes(pages).collect()}
    assert got == {
        1: (2, "success", 3, 1, False), 2: (2, "partial", 2, None, None), 3: (1, "unavailable", None, None, None), 4: (1, "failed", None, None, None),
        5: (1, "partial", 1, 0, True), 6: (1, "success", 0, 0, False),
    }


def test_edges_of_snapshots_are_derived_once(spark):
    post = lambda uri, did: f'"post": {{"uri": "{uri}", "author": {{"did": "{did}"}}}}'
    blocked = '{"$type": "x#blockedPost", "uri": "b"}'
    thread = f'{{"thread": {{{post("s", "me")}, "replies": [{{{post("r1", "you")}, "replies": []}}, {blocked}]}}}}'
    reposts = '{"repostedBy": [{"did": "z"}, {"did": "z"}]}'
    rows = [("1", "thread", "s", True, thread), ("2", "reposts", "s", True, reposts), ("3", "reposts", "s", False, reposts), ("4", "quotes", "s", True, "no json"), ("5", "quotes", "s", True, None)]
    edges = payloads.snapshot_edges(spark.createDataFrame(rows, "snapshot_id string, endpoint string, seed_uri string, ok boolean, body string"))
    first = interaction.derive_run(edges, spark.createDataFrame([], "snapshot_id string, key string"))
    assert sorted((r.snapshot_id, r.edge_type, r.source or "", r.target, r.actor) for r in first.collect()) == [
        ("1", "author", "", "r1", "you"), ("1", "author", "", "s", "me"), ("1", "reply", "r1", "s", "you"), ("2", "repost", "", "s", "z"),
    ]
    assert interaction.derive_run(edges, first).count() == 0


def test_both_directions_and_flows_of_two_versions(spark):
    schema = "post_id int, is_relevant boolean, is_cyber boolean, is_canada boolean, topic_key string"
    a = spark.createDataFrame([(1, True, True, True, "x"), (2, True, True, True, None), (3, False, True, True, "x"), (4, True, True, True, "x")], schema)
    b = spark.createDataFrame([(1, True, True, True, "y"), (2, False, True, False, "x"), (3, True, True, True, "x")], schema)
    assert {(r.direction, r.is_canada, r.posts) for r in evaluation.gate_diff(a, b).collect()} == {("a_only", False, 1), ("b_only", None, 1)}
    got = {r.topic: (r.a, r.b, r.left, r.gained, r.change) for r in evaluation.migration_topics(evaluation.label_migration(a, b)).collect()}
    assert got == {"x": (1, 1, 1, 1, 0.0), "y": (0, 1, 0, 1, None), "other": (1, 0, 1, 0, -1.0)}
