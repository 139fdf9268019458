import random

import numpy as np

from hubbub.operators.percentiles import exact_percentiles

WANTED = {"low": 0.0, "q1": 0.25, "median": 0.5, "p90": 0.9, "high": 1.0}


def plain(rows):
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    return {g: (len(v), *(float(np.percentile(v, 100 * p)) for p in WANTED.values())) for g, v in groups.items()}


def check(spark, rows, **limits):
    out = exact_percentiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", WANTED, **limits).collect()
    want = plain(rows)
    assert {r.g for r in out} == set(want)
    for r in out:
        assert r.n == want[r.g][0] and np.allclose([r[c] for c in WANTED], want[r.g][1:], rtol=1e-12, atol=0)


def test_many_levels_equal_a_plain_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.gauss(0, 1) * 10 ** rng.randint(-8, 8)) for _ in range(3000)]
    rows += [("b", 5.0)] * 1500 + [("c", -2.5)] * 40 + [("d", 1.0), ("d", 2.0), (None, 3.0), (None, -4.0), ("e", None), ("a", float("nan")), ("f", 1e308), ("f", -1e308), ("f", 0.0)]
    check(spark, rows, fan=8, few=20)


def test_few_values_and_whole_tables(spark):
    check(spark, [("a", float(x)) for x in range(101)] + [("b", 7.0)])
    assert exact_percentiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", WANTED).collect() == []
    whole = exact_percentiles(spark.createDataFrame([("a", 1.0), ("b", 4.0)], "g string, x double"), [], "x", {"m": 0.5}).collect()
    assert [tuple(r) for r in whole] == [(2, 2.5)]


def test_a_million_values_are_narrowed_down(spark):
    rows = spark.range(1_000_000).selectExpr("cast((id * 7919) % 1000003 as double) as x")
    r = exact_percentiles(rows, [], "x", {"median": 0.5, "p99": 0.99}, fan=64, few=500).first()
    x = (np.arange(1_000_000) * 7919) % 1000003
    assert (r.n, r.median, r.p99) == (1_000_000, float(np.percentile(x, 50)), float(np.percentile(x, 99)))
