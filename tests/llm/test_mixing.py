"""Pareto order sampling against a plain one in Python, and what equal-probability sampling would give."""

import hashlib
from collections import defaultdict

import pytest

from hubbub.llm import mixing

DOCS = "doc_id long, text string, source string"


def brute(rows, weights=(3, 1, 2)):
    """(doc_id, size) -> copies, and the same with the documents ordered by u alone."""
    size = lambda t: len([w for w in (t or "").split() if w])
    by = defaultdict(list)
    for doc_id, text, source in rows:
        by[source].append((doc_id, size(text)))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, n in by[s]) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, free, target = 1.5 * sum(total.values()), set(names), {}
    while free:
        level = (goal - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in over} if over else {s: level * weight[s] for s in free}
        free -= over or free
    pareto, plain = [], []
    for s in names:
        certain = int(target[s] // total[s]) if total[s] else 0
        left = target[s] - certain * total[s]
        u = {d: (int(hashlib.md5(f"7:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for d, _ in by[s]}
        k = lambda n: len(f"{n:b}")
        low, high = 0.0, 1e9  # c by bisection
        for _ in range(200):
            c = (low + high) / 2
            low, high = (c, high) if sum(n * min(1, c * k(n)) for _, n in by[s]) < left else (low, c)
        p = {n: min(1.0, high * k(n)) for _, n in by[s]}
        odds = lambda d, n: 0.0 if p[n] == 1 else u[d] / (1 - u[d]) / (p[n] / (1 - p[n]))
        for out, order in ((pareto, odds), (plain, lambda d, n: u[d])):
            taken = 0
            for d, n in sorted(by[s], key=lambda r: (order(*r), *r)):
                more = left > 0 and taken + n / 2 <= left
                taken += n
                out.append((d, n, certain + more))
    return sorted(pareto), sorted(plain), target


def test_mix_takes_what_pareto_sampling_takes_and_not_what_u_alone_would(spark):
    rows = [(i, "w " * (1 + i * i % 701), f"s{i % 3}" if i % 7 else None) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    pareto, plain, target = brute(rows)
    assert sorted((r.doc_id, r.size, r.copies) for r in got) == pareto != plain
    for source, goal in target.items():
        assert abs(sum(r.size * r.copies for r in got if r.source == source) - goal) <= 701


def test_longer_documents_are_taken_more_readily(spark):
    rows = [(i, "w " * (2 if i % 2 else 900), "a" if i < 3000 else "b") for i in range(6000)]
    got = [r for r in mixing.mix(spark.createDataFrame(rows, DOCS), weights=(1, 3), share=0.8).collect() if r.source == "a"]
    short, long = ([r.copies for r in got if r.size == n] for n in (2, 900))
    assert sum(short) / len(short) < sum(long) / len(long) < 1


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, "", "a"), (1, "", "a"), (2, None, "b")], [(1, "x y", "a"), (1, "x y", "a"), (None, "x y z", None)]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS size", "2 AS u", "3 AS k", "4 AS rank", "5 AS copies", "6 AS of")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 2 for r in got)
