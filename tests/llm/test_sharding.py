"""Shards: the capacity against dynamic programming, whole groups, gapless slots, odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from hubbub.llm import queries, sharding

ROWS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def best_capacity(sizes, shards):
    """Smallest possible largest run, by dynamic programming over all cuts."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[i], sums[j] - sums[i]) for i in range(j + 1)) for j in range(len(sizes) + 1)]
    return best[-1]


def plain(rows, shards):
    """(capacity of the runs, groups with a shard of their own) for rows of (doc_id, text)."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    sized = sorted((min((-1 if d is None else d) for d in ids), (len(text.encode()) + 16) * len(ids), text) for text, ids in groups.items())
    left, free, own = sum(s for _, s, _ in sized), shards, set()
    for _, size, text in sorted(sized, key=lambda g: -g[1]):
        if size * free <= left:
            break
        own.add(text)
        left, free = left - size, free - 1
    return best_capacity([s for _, s, t in sized if t not in own], free), own, free


def check(rows, out, shards):
    capacity, own, free = plain(rows, shards)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    by_shard, by_text = defaultdict(list), defaultdict(set)
    for r in out:
        by_shard[r.shard].append(r)
        by_text[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values()) and all(0 <= s < shards for s in by_shard)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by_shard.values())
    runs = [sum(r.size for r in x) for s, x in by_shard.items() if s < free]
    assert max(runs, default=0) == (capacity if runs else 0)
    assert {s for t in own for s in by_text[zlib.crc32(t.encode())]} == set(range(free, shards))


@pytest.mark.parametrize("summary", [20, 1 << 16])
@pytest.mark.parametrize("shards", [3, 8])
def test_shards_have_the_smallest_capacity(spark, shards, summary):
    rng = random.Random(shards)
    rows = [(i, "x" * rng.choice([0, 1, 5, 90, rng.randint(0, 400)]) + str(rng.randint(0, 60))) for i in range(150)]
    rows += [(1000 + i, "hot " * 30) for i in range(80)] + [(None, None), (None, ""), (5, "twice"), (5, "twice"), (7, "ünïcødé ✓")]
    rng.shuffle(rows)
    check(rows, sharding.shard(spark.createDataFrame(rows, ROWS).repartition(5), shards=shards, summary=summary).collect(), shards)


def test_few_groups_empty_tables_and_clashing_names(spark):
    assert sharding.shard(spark.createDataFrame([], ROWS), shards=4).collect() == []
    rows = [(1, "a"), (2, "b" * 300)]
    check(rows, sharding.shard(spark.createDataFrame(rows, ROWS), shards=5).collect(), 5)
    odd = spark.createDataFrame([(1, "a", 3, 4, 5), (2, "b", 3, 4, 5)], "doc_id long, text string, size long, shard int, part int")
    assert {(r.doc_id, r.size, r.slot) for r in sharding.shard(odd, shards=1).collect()} == {(1, 17, 0), (2, 17, 1)}
    with pytest.raises(ValueError):
        sharding.shard(odd, shards=0)


def test_refined_search_equals_the_whole_one(spark):
    rng = random.Random(3)
    sums, total = [], 0
    for n in range(5000):
        total += rng.choice([1, 7, 300, 5000])
        sums.append((n, total))
    table = spark.createDataFrame(sums, "n long, upto long").cache()
    exact = sharding.Sums(sums).capacity(17, False)
    for summary in (40, 300, 6000):
        capacity, known = sharding.smallest_capacity(table, 5000, 17, summary)
        cuts = [0, *known.cuts(17, capacity), total]
        assert capacity == exact and max(b - a for a, b in zip(cuts, cuts[1:])) == exact and set(cuts[1:]) <= {s for _, s in sums}
        assert min(b - a for a, b in zip(cuts, cuts[1:])) > 0.97 * exact


def test_query_over_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.op13_sharding(spark, SF).collect()
    check(rows, out, 40)
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}
