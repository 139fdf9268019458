"""Recall of the filters by number of vectors, low dimensions, and ids that repeat."""

import math

import numpy as np
import pytest

from hubbub.llm import sphere_filters
from hubbub.llm.sphere_filters import FilterCode, Filters


def pairs(dim, n, cosine=0.9):
    rng = np.random.default_rng(8)
    x, z = rng.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize("count", [1, 500, 1000, 1024, 1025, 1e5, 1e7, 1e9])
def test_recall_at_the_limit_by_number_of_vectors(count):
    plan = Filters(64, int(count))
    code, (x, y) = FilterCode(plan), pairs(64, 250)
    own, other = code.filters(x), code.filters(y)
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(own, other)]) >= (0.99 if count > 1e6 else 0.995)
    assert np.mean([len(a) for a in own]) <= plan.most


@pytest.mark.parametrize("dim", [2, 8, 65])
def test_any_length_links_as_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(1100, dim))
    x[:200] = x[200:400] + rng.normal(size=(200, dim)) * 0.2 / math.sqrt(dim) * np.linalg.norm(x[200:400], axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {r.id: r for r in sphere_filters.near_vectors(df, block=700).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    found = np.array([out[i].n_links for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum() > 0


def test_one_longer_vector_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(50, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, base + 0.01]))] + [(500, rng.normal(size=65).tolist())]
    # one id with two vectors, each near another id; a repeated row
    far = rng.normal(size=(2, 64))
    rows += [(700, far[0].tolist()), (700, far[1].tolist()), (702, (far[0] + 0.01).tolist()), (703, (far[1] + 0.01).tolist()), (703, (far[1] + 0.01).tolist())]
    got = sorted(tuple(r) for r in sphere_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got[:100] == [(i, 1, i % 50) for i in range(100)] and got[100] == (500, 0, 500)
    assert got[101:] == [(700, 1, 700), (700, 2, 700), (702, 1, 700), (703, 2, 700), (703, 2, 700)]


def test_a_clash_of_names_and_floats(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.1, 0.0]), (None, [0.0, 0.0, 1.0])], "vec_id long, embedding array<float>")
    df = df.selectExpr("*", "1 AS node", "2 AS filter", "3 AS id", "4 AS component")
    assert sorted((r.id or 0, r.n_links, r.component or 0) for r in sphere_filters.near_vectors(df).collect()) == [(0, 0, 0), (1, 1, 1), (2, 1, 1)]
