"""Draws of the author test: against plain shifts, for all scales, whatever the partitions."""

import random
from datetime import datetime, timedelta

import numpy as np

from hubbub.operators import nullmodel

AS_OF, W = "2024-01-29 00:00:00", 3
END = datetime(2024, 1, 29)


def posts_of(spark, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice("xyz"), rng.choice([*"abcdefg", None]), END - timedelta(hours=rng.randint(1, 24 * 2 * W))) for _ in range(200)]
    return rows, spark.createDataFrame(rows, "topic string, author_id string, published_at timestamp_ntz")


def plain(rows, iterations, scale):
    out, draws = {}, nullmodel.coefficients(iterations)
    for topic, author, at in rows:
        day = (at - (END - timedelta(days=2 * W))).days
        for copy in range(1, scale + 1):
            moved = (day + nullmodel.shifts(author or "", copy, draws, 2 * W)) % (2 * W)
            out[topic] = out.get(topic, 0) + np.where(moved >= W, 1, -1)
    return out


def test_all_scales_equal_plain_shifts(spark):
    rows, posts = posts_of(spark)
    drawn = nullmodel.shift_sums(nullmodel.cells(posts, AS_OF, W), W, 50, (1, 3, 4)).collect()
    for scale in (1, 3, 4):
        want = plain(rows, 50, scale)
        assert {(r.topic, r.iteration): r.delta for r in drawn if r.scale == scale} == {(t, i): d for t, x in want.items() for i, d in enumerate(x.tolist())}
    for r in nullmodel.power_scale(posts, AS_OF, W, 50, (1, 4)).collect():
        want = plain(rows, 50, r.scale)
        limit = float(np.percentile(np.abs(np.stack(list(want.values()))).max(0), 95))
        now = sum(1 if at >= END - timedelta(days=W) else -1 for t, _, at in rows if t == r.topic)
        assert (r.observed, r.max_null_p95, r.above) == (r.scale * now, round(limit, 6), abs(r.scale * now) > round(limit, 6))


def test_shifts_are_even_and_differ_by_copy():
    draws = nullmodel.coefficients(4000)
    many = np.concatenate([nullmodel.shifts(f"a{i}", 1, draws, 14) for i in range(50)])
    assert np.abs(np.bincount(many, minlength=14) / len(many) - 1 / 14).max() < 0.003
    assert (nullmodel.shifts("a", 1, draws, 14) == nullmodel.shifts("a", 2, draws, 14)).mean() < 0.1
    pairs = nullmodel.shifts("a", 1, draws, 2) + 2 * nullmodel.shifts("b", 1, draws, 2)
    assert np.abs(np.bincount(pairs, minlength=4) / 4000 - 0.25).max() < 0.03


def test_partitions_do_not_matter_and_no_posts_give_no_draws(spark):
    _, posts = posts_of(spark, 5)
    one, many = (sorted(map(tuple, nullmodel.author_shift(posts.repartition(n), AS_OF, W, 20).collect())) for n in (1, 40))
    assert one == many and len(one) == 60
    assert nullmodel.author_shift(posts.limit(0), AS_OF, W, 5).collect() == nullmodel.power_scale(posts.limit(0), AS_OF, W, 5, (1, 2)).collect() == []
