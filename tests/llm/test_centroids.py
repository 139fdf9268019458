"""Clusters: against plain k-means, cells and bounds, odd vectors."""

import hashlib
import random

import numpy as np
import pytest

from hubbub.llm import centroids

ROWS = "vec_id long, embedding array<double>"


def plain(rows, plan):
    """[(id, cluster, distance)] by exact integers of Python."""
    kept = [(i, [int(np.floor(plan.scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == plan.dim and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{plan.seed}{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes())
    centres = [v for _, v in sorted(kept, key=key)[: plan.k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(plan.rounds):
        of = [nearest(v)[1] for _, v in kept]
        for k in range(len(centres)):
            own = [v for (_, v), o in zip(kept, of) if o == k]
            if own:
                centres[k] = [sum(c) // len(own) for c in zip(*own)]
    return sorted(((i, *nearest(v)[::-1]) for i, v in kept), key=repr), centres


def data(dim, n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    x = centres[rng.integers(0, 5, n)] + rng.normal(size=(n, dim)) * 0.6
    return [(i, row.tolist()) for i, row in enumerate(x)]


@pytest.mark.parametrize(("dim", "bits", "scale"), [(7, 4, 64), (8, 2, 3), (5, 3, 1)])
def test_clusters_equal_plain_ones(spark, dim, bits, scale):
    plan = centroids.Plan(k=6, rounds=3, dim=dim, scale=scale, bits=bits)
    rows = data(dim, 400, dim)
    rows += [(3, rows[0][1]), (3, rows[0][1]), (7, [1e300] + [0.0] * (dim - 1)), (900, None), (901, []), (902, [None] * dim), (903, [float("nan")] * dim), (904, [float("-inf")] * dim), (905, [1.0] * (dim + 1)), (None, [0.5] * dim)]
    rows = [(7, [2.0**20] + [0.0] * (dim - 1)) if r[1] and r[1][0] == 1e300 and scale < 64 else r for r in rows]
    random.Random(1).shuffle(rows)
    rows = [r for r in rows if not (r[1] and r[1][0] == 1e300)]
    out, centres = centroids.cluster(spark.createDataFrame(rows, ROWS).repartition(5), plan)
    want, final = plain(rows, plan)
    assert sorted(((r.id, r.cluster, r.distance) for r in out.collect()), key=repr) == want
    assert centres.tolist() == final


def test_few_vectors_none_and_huge_ones(spark):
    plan = centroids.Plan(k=4, dim=2)
    assert centroids.cluster(spark.createDataFrame([], ROWS), plan)[0].collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None), (2, [1.0])], ROWS), plan)[0].collect() == []
    out, centres = centroids.cluster(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1e300, -1e300]), (3, [1e200, -1e200])], ROWS), plan)
    got = {r.id: (r.cluster, r.distance) for r in out.collect()}
    assert len(centres) == 3 and {d for _, d in got.values()} == {0} and got[2] == got[3] != got[1]


def test_bounds_hold_every_distance_and_cells_decide_most_rows():
    rng = np.random.default_rng(4)
    x = centroids.integers(rng.normal(size=(2000, 64)) * 0.125 + rng.normal(size=(8, 64))[rng.integers(0, 8, 2000)] * 0.1, 64)
    at = centroids.Cells(x.mean(0), x.std(0), 6).of(x)
    low, high = np.zeros((64, 64), np.int64), np.zeros((64, 64), np.int64)
    for c in range(64):
        for j in range(64):
            own = x[at[:, c] == j, c]
            if len(own):
                low[c, j], high[c, j] = own.min(), own.max()
    centres = x[:16]
    open_ = centroids.Bounds(centres, low, high, np.rint(x.mean(0)).astype(int)).open(at)
    exact = np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)
    assert open_[np.arange(2000), exact.argmin(1)].all()
    assert (open_.sum(1) == 1).mean() > 0.4 and open_.mean() < 0.2
    assert (centroids.nearest(x, open_, centres) == exact.argmin(1)).all()


@pytest.mark.parametrize("bits", range(1, 9))
def test_cells_read_back(bits):
    cells = np.random.default_rng(bits).integers(0, 2**bits, (9, 13)).astype(np.uint8)
    assert (centroids.unpacked([r.tobytes() for r in centroids.packed(cells, bits)], 13, bits) == cells).all()
    assert centroids.unpacked([], 13, bits).shape == (0, 13) and len(centroids.packed(cells[:0], bits)) == 0


def test_extra_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 5, 6, 7), (2, [3.0, 4.0], 5, 6, 7)], "vec_id long, embedding array<float>, node long, cells int, cluster int")
    assert {r.id for r in centroids.cluster(rows, centroids.Plan(k=2, dim=2))[0].collect()} == {1, 2}
