"""Large groups, repeated ids and chained classes of the near-duplicate search."""

import random

import pytest

from hubbub.llm import setsketch
from hubbub.llm.components import connected_components
from tests.llm.test_operators import brute_components, documents

ROWS = "doc_id long, text string"


def test_ids_that_repeat_with_other_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " x"), (4, "alone"), (None, a + " y"), (None, "other"), (4, "alone")], ROWS)
    out = setsketch.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component or 0) for r in out) == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]
    assert sorted((r.doc_id or 0) for r in out if r.first) == [0, 1, 1, 4, 4]


def test_blocks_give_what_brute_force_gives(spark):
    """Many classes in one chained group, over many blocks."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(6):
        middle = list(base)
        for at in range(0, 120, 12):
            middle[at] = f"m{k}x{at}"
        for _ in range(40):
            copy = list(middle)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(120)] = f"z{rng.randrange(50)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    out = {r.doc_id: r for r in setsketch.near_duplicates(documents(spark, texts), setsketch.Plan(block=16, bands=40, rows=3)).collect()}
    component, _ = brute_components(texts, 3, 85)
    assert len(set(component)) > 1 and [out[i].component for i in range(len(texts))] == component


@pytest.mark.parametrize("n", [6_000])
def test_many_near_copies_of_one_text(spark, n):
    docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 80), i -> concat('t', if(i = 40 + id % 3, id, i)))) AS text")
    out = setsketch.near_duplicates(docs.repartition(8))
    assert out.where("component = 0").count() == n and out.where("first").count() == 1


def test_a_small_graph_takes_few_jobs(spark):
    """A run with many partitions pays for every shuffle, however few edges there are."""
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1400)], "u long, v long")
    spark.sparkContext.setJobGroup("few jobs", "")
    try:
        out = connected_components(links)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few jobs"))
    finally:
        spark.sparkContext.setJobGroup("others", "")
    assert sorted({r.component for r in out.collect()}) == [0, 1000] and out.count() == 701
    assert jobs <= 6
