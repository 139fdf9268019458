"""Streams: restart with counters, state on disk, odd paths, timers that settle posts."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hubbub.streaming import ingest, settling

NOON = datetime(2024, 1, 1, 12)


def add(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/tmp")
    part = next(f for f in os.listdir(f"{folder}/tmp") if f.startswith("part-"))
    os.makedirs(f"{folder}/in", exist_ok=True)
    os.rename(f"{folder}/tmp/{part}", f"{folder}/in/{name}.parquet")


@pytest.mark.parametrize("name", ["plain", "odd [1] {a,b} *"])
def test_a_restart_goes_on_with_what_is_new(spark, tmp_path, name):
    folder = tmp_path / name
    folder.mkdir()
    at = lambda h: NOON + timedelta(hours=h)
    schema = "id long, published_at timestamp"

    def run():
        stream = ingest.read_stream(spark, f"{folder}/in")
        return ingest.ingest(stream, ["id"], f"{tmp_path}/rows", f"{tmp_path}/checkpoint", None).collect()

    add(spark, folder, "one", [(1, at(0)), (2, at(5)), (1, at(0))], schema)
    first = run()
    assert [(r.fetched, r.kept, r.late, r.first_at, r.last_at) for r in first] == [(3, 2, 0, at(0), at(5))]
    assert run() == []
    add(spark, folder, "two", [(2, at(5)), (3, at(-90)), (3, at(-90))], schema)
    second = run()
    assert [(r.fetched, r.kept) for r in second] == [(3, 1)] and second[0].batch > first[0].batch and second[0].run_id != first[0].run_id
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/rows").collect()) == [1, 2, 3]
    state = [f for _, _, files in os.walk(f"{tmp_path}/checkpoint/state") for f in files]
    assert any(f.endswith((".changelog", ".zip")) for f in state) and not any(f.endswith(".delta") for f in state)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


SNAPSHOT = "post_id long, author_id string, published_at timestamp, collected_at timestamp, engagement long"


def test_posts_settle_once_with_their_newest_snapshot(spark, tmp_path):
    at = lambda h: NOON + timedelta(hours=h)

    def run():
        settling.settle(ingest.read_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/rows", f"{tmp_path}/checkpoint", hours=24, forget_hours=48)
        rows = spark.read.schema(settling.SETTLED).parquet(f"{tmp_path}/rows")
        return sorted((r.post_id, r.engagement, r.collected_at) for r in rows.collect())

    add(spark, tmp_path, "a", [(1, "x", at(0), at(1), 5), (1, "x", at(0), at(2), 7), (2, "y", at(1), at(3), None), (3, "y", None, at(3), 1), (None, "y", at(0), at(3), 1)], SNAPSHOT)
    assert run() == []
    add(spark, tmp_path, "b", [(1, "x", at(0), at(20), 9), (4, "z", at(20), at(24.5), 1)], SNAPSHOT)
    assert run() == [(1, 9, at(20))]
    add(spark, tmp_path, "c", [(1, "x", at(0), at(26), 99), (4, "z", at(20), at(44.5), 3)], SNAPSHOT)
    assert run() == [(1, 9, at(20)), (2, None, at(3)), (4, 3, at(44.5))]
    assert run() == [(1, 9, at(20)), (2, None, at(3)), (4, 3, at(44.5))]
    assert spark.read.parquet(f"{tmp_path}/rows").where(F.col("post_id") == 1).first().published_at == at(0)


def test_a_bucket_of_posts_is_one_entry_of_state(spark, tmp_path):
    """Many posts in few buckets, over three batches, against a plain loop."""
    rng, waiting, settled, clock = random.Random(3), {}, {}, -1
    ms = lambda t: round((t - NOON).total_seconds() * 1000)
    for batch in range(3):
        rows = []
        for _ in range(1500):
            post = rng.randrange(900)
            published = NOON + timedelta(minutes=post)
            collected = published + timedelta(hours=12 * batch, minutes=rng.randrange(600), milliseconds=rng.randrange(1000))
            rows.append((post, f"u{post}", published, collected, rng.choice([None, 0, rng.randrange(9), 2**60 + 1])))
        add(spark, tmp_path, f"b{batch}", rows, SNAPSHOT)
        for post, _, _, collected, engagement in rows:
            if post not in settled and ms(collected) > clock:
                waiting[post] = max(waiting.get(post, (datetime.min, -1, False)), (collected, engagement or 0, engagement is not None))
        clock = max(clock, *(ms(r[3]) for r in rows))
        for post in [p for p in waiting if p * 60_000 + 20 * 3_600_000 < clock]:
            settled[post] = waiting.pop(post)
        settling.settle(ingest.read_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/rows", f"{tmp_path}/checkpoint", hours=20, forget_hours=5000, buckets=4)
        got = {r.post_id: (r.collected_at, r.engagement) for r in spark.read.schema(settling.SETTLED).parquet(f"{tmp_path}/rows").collect()}
        assert got == {p: (v[0], v[1] if v[2] else None) for p, v in settled.items()}
        assert spark.read.parquet(f"{tmp_path}/rows").count() == len(got) and (batch or (settled and waiting))
    assert spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/checkpoint").count() == 4
