"""Near-duplicate vectors by spherical-cap filters.

After a structured random rotation (signs, Walsh-Hadamard, permutation, signs) a vector is cut into two blocks,
each compared with a small random code. The product of the two codes is a code of many directions; a vector
belongs to every direction whose inner product exceeds a threshold. They are listed without visiting the
others: a block's directions that cannot reach the threshold with the best of the other block are skipped. Vectors
that share a filter are joined on it and verified by their exact cosine in double precision.

The threshold follows the number of vectors: filters keep about `bucket` members. It comes from the exact measure of
spherical caps, and the number of directions from the exact chance that two vectors at the limit share a cap, so
that such a pair shares `expected` filters at every size, and more of them where few vectors make filters wide. Simulated recall at the limit, for 1e3 to 1e9 vectors, is in
the tests; against brute force it is measured there too.

A pair is counted in the first filter that both share, so links need no distinct over pairs; inside
a filter blocks of bounded size meet each other, and only each vector's count and a spanning forest leave a
block. Equal vectors are folded into one with a weight and known by a number of its own, not by its id. A vector
travels to each of its filters as bytes of the precision that it has in the table.

Vectors of each length are searched by a code of their own, so all of equal length are compared, and vectors of
different lengths never link. However few vectors a length has, they are found by filters. Vectors that
are null, empty, zero, or hold null or non-finite components link with nothing. Repeated rows link with each other.
Rows that share an id but not the vector are vectors of their own: each gets its own links and the smallest id of its
own component. A null id is no number: such a vector links like any other, and its component is that of the ids in it. Empty tables give no rows. Labels and other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubbub.llm.common import stage
from hubbub.llm.components import connected_components

_EDGES = pd.DataFrame({"u": [], "v": [], "n": []}, dtype="int64")


def _caps(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles and the share of the sphere within each of them of a point."""
    angle = np.linspace(0, math.pi, 8001)
    density = np.sin(angle) ** (dim - 2)
    grown = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return angle, grown / grown[-1]


def cap_level(dim: int, tail: float) -> float:
    """The inner product that a share `tail` of the sphere exceeds."""
    angle, share = _caps(dim)
    return math.cos(np.interp(math.log(tail), np.log(np.maximum(share, 1e-300)), angle))


def cap_shared(dim: int, tail: float, cosine: float) -> float:
    """The chance that y is in a cap of that share if x is, for a pair at that cosine."""
    level = cap_level(dim, tail)
    angle = np.linspace(0, math.acos(level), 801)[1:]
    weight = np.sin(angle) ** (dim - 2)
    beyond = (level - cosine * np.cos(angle)) / (math.sqrt(1 - cosine * cosine) * np.sin(angle))
    other, share = _caps(dim - 1)
    return float(weight @ np.interp(np.arccos(np.clip(beyond, -1, 1)), other, share) / weight.sum())


@dataclass(frozen=True)
class Filters:
    """dim: length of the vectors, of which there are count. limit: the cosine at which a pair shares `expected`
    filters on average. Rare filters would need very many: beyond `most` a vector, filters are made larger."""

    dim: int
    count: int
    limit: float = 0.9
    bucket: int = 1024
    codes: int = 32
    expected: float = 9.0
    most: int = 80
    seed: int = 5

    @property
    def width(self) -> int:
        """Dimensions after zeros are added: short vectors get enough for two blocks of many directions."""
        return max(16, 1 << math.ceil(math.log2(max(2, self.dim))))

    @cached_property
    def shape(self) -> tuple[int, float]:
        """Directions in each block's code and the share of all vectors in a filter."""
        tail = min(0.04, self.bucket / max(1, self.count))
        while self.expected / cap_shared(self.width, tail, self.limit) > self.most:
            tail *= 1.25
        # wide filters need few directions, whose shares vary more from vector to vector: more of them even that out
        wanted = self.expected * (1 + 20 * tail)
        size = math.ceil(math.sqrt(wanted / cap_shared(self.width, tail, self.limit) / self.codes / tail))
        low, high = tail / 4, tail * 2
        for _ in range(30):  # the level at which so many directions give `expected`
            mid = math.sqrt(low * high)
            enough = self.codes * size**2 * mid * cap_shared(self.width, mid, self.limit) >= wanted
            low, high = (low, mid) if enough else (mid, high)
        return size, high

    @property
    def size(self) -> int:
        return self.shape[0]

    @property
    def numbers(self) -> int:
        """Numbers that the filters take up."""
        return self.codes * self.size**2


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class FilterCode:
    def __init__(self, plan: Filters):
        self.plan, self.width = plan, plan.width
        self.level = cap_level(self.width, plan.shape[1]) * math.sqrt(2)
        self.codes = []
        for k in range(plan.codes):
            rng = np.random.default_rng((plan.seed, k))
            signs = rng.choice([-1.0, 1.0], (2, self.width))
            moved = rng.permutation(self.width)
            code = rng.normal(size=(2, plan.size, self.width // 2))
            self.codes.append((signs, moved, code / np.linalg.norm(code, axis=2, keepdims=True)))

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row the sorted numbers of its filters."""
        x = np.zeros((len(unit), self.width))
        x[:, : unit.shape[1]] = unit
        rows, numbers, half, size = [], [], self.width // 2, self.plan.size
        at_once = max(1, (1 << 22) // size)
        for k, (signs, moved, code) in enumerate(self.codes):
            y = _hadamard(_hadamard(x * signs[0])[:, moved] * signs[1])
            a, b = y[:, :half] @ code[0].T, y[:, half:] @ code[1].T
            row, i = np.nonzero(a >= self.level - b.max(1)[:, None])
            for low in range(0, len(row), at_once):
                r, part = row[low : low + at_once], i[low : low + at_once]
                at, j = np.nonzero(a[r, part][:, None] + b[r] >= self.level)
                rows.append(r[at])
                numbers.append((k * size + part[at]) * size + j)
        row, number = np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *numbers])
        order = np.lexsort((number, row))
        return np.split(number[order], np.searchsorted(row[order], np.arange(1, len(unit))))


def _units(table: DataFrame, vector_id: str, vector: str) -> DataFrame:
    """id, key (of the components; null if the vector links with nothing), dim and the vector's bytes."""
    dtype = "<f4" if table.select(F.col(vector)).schema[0].dataType.simpleString() == "array<float>" else "<f8"

    def check(batches):
        for batch in batches:
            keys, dims, vectors = [], [], []
            for v in batch["vector"].to_pylist():
                x = np.array([np.nan] if not v or None in v else v, np.float64) + 0.0  # no negative zero
                good = bool(np.isfinite(x).all() and x.any())
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if good else None)
                dims.append(len(x) if good else None)
                vectors.append(x.astype(dtype).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())], ["id", "key", "dim", "vector"])

    kind = "array<float>" if dtype == "<f4" else "array<double>"
    rows = table.select(F.col(vector_id).cast("long").alias("id"), F.col(vector).cast(kind).alias("vector"))
    return rows.mapInArrow(check, "id long, key binary, dim int, vector binary")


def _matrix(vectors, dim: int) -> np.ndarray:
    """Unit rows from the vectors' bytes."""
    raw = b"".join(vectors)
    x = np.frombuffer(raw, "<f4" if len(raw) == 4 * dim * len(vectors) else "<f8").reshape(-1, dim).astype(float)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _meet_before(a: pd.DataFrame, b: pd.DataFrame, close: np.ndarray) -> np.ndarray:
    """Which pairs share one of the filters in `before`; only rows with a close pair are looked at."""
    met = np.zeros(close.shape, bool)
    owners = []
    for side, axis in ((a, 1), (b, 0)):
        rows = np.flatnonzero(close.any(axis))
        lists = [np.asarray(side.before.iat[r], np.int64) for r in rows]
        number = np.concatenate([np.zeros(0, np.int64), *lists])
        order = np.argsort(number, kind="stable")
        owners.append((number[order], np.repeat(rows, [len(x) for x in lists])[order]))
    (fa, ra), (fb, rb) = owners
    both = np.intersect1d(fa, fb)
    spans = [np.searchsorted(f, both, side) for f in (fa, fb) for side in ("left", "right")]
    for a0, a1, b0, b1 in zip(*spans):
        met[np.ix_(ra[a0:a1], rb[b0:b1])] = True
    return met


def _verify(limit: float):
    def verify(cell: pd.DataFrame) -> pd.DataFrame:
        own_block = int(cell.low.iat[0]) == int(cell.high.iat[0])
        a = cell[cell.own == cell.low]
        b = a if own_block else cell[cell.own == cell.high]
        if not len(a) or not len(b):
            return _EDGES
        dim = int(cell.dim.iat[0])
        close = _matrix(a.vector.to_list(), dim) @ _matrix(b.vector.to_list(), dim).T >= limit
        if own_block:
            np.fill_diagonal(close, False)
        if not close.any():
            return _EDGES
        close &= ~_meet_before(a, b, close)
        i, j = np.nonzero(close)
        nodes_a, nodes_b, weight_a, weight_b = a.node.to_numpy(), b.node.to_numpy(), a.weight.to_numpy(), b.weight.to_numpy()
        links_a = close @ weight_b
        links_b = np.zeros(len(b), "int64") if own_block else weight_a @ close
        # a spanning forest: labels fall to the smallest node that is reached within the block
        nodes, at = np.unique(np.concatenate([nodes_a[i], nodes_b[j]]), return_inverse=True)
        p, q, label = at[: len(i)], at[len(i) :], np.arange(len(nodes))
        while True:
            new = label.copy()
            np.minimum.at(new, p, label[q])
            np.minimum.at(new, q, label[p])
            new = new[new]
            if (new == label).all():
                break
            label = new
        tree = label != np.arange(len(nodes))
        counts = pd.DataFrame({"u": np.concatenate([nodes_a, nodes_b]), "n": np.concatenate([links_a, links_b])})
        counts = counts[counts.n > 0].assign(v=-1)
        edges = pd.DataFrame({"u": nodes[tree], "v": nodes[label[tree]], "n": -1})
        return pd.concat([counts, edges])[["u", "v", "n"]].astype("int64")

    return verify


def near_vectors(table: DataFrame, *, vector_id: str = "vec_id", vector: str = "embedding", limit: float = 0.9, block: int = 2048) -> DataFrame:
    """id, n_links, component of each row of table."""
    rows = stage(_units(table, vector_id, vector), "vectors")
    good = rows.where("key is not null")
    reps = good.groupBy("key").agg(F.min(F.struct("id", "dim", "vector")).alias("rep"), F.count(F.lit(1)).alias("weight"))
    reps = stage(reps.select(F.monotonically_increasing_id().alias("node"), "key", "rep.*", "weight"), "distinct-vectors")
    lengths = reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()
    plans, first = {}, 0  # length -> its filters and the number of the first one
    for dim, n in lengths:
        plans[dim] = Filters(dim, n, limit), first
        first += plans[dim][0].numbers

    def listed(batches):
        coders = {}
        for batch in batches:
            dims, vectors, filters = batch["dim"].to_numpy(), batch["vector"].to_pylist(), [[]] * batch.num_rows
            for dim in np.unique(dims).tolist():
                plan, base = plans[dim]
                places = np.flatnonzero(dims == dim)
                for low in range(0, len(places), 1024):
                    part = places[low : low + 1024]
                    if dim not in coders:
                        coders[dim] = FilterCode(plan)
                    found = coders[dim].filters(_matrix([vectors[at] for at in part], dim))
                    for at, f in zip(part, found):
                        filters[at] = (f + base).tolist()
            yield pa.RecordBatch.from_arrays([batch["node"], batch["dim"], batch["vector"], batch["weight"], pa.array(filters, pa.list_(pa.int64()))], ["node", "dim", "vector", "weight", "filters"])

    listed_rows = reps.select("node", "dim", "vector", "weight").mapInArrow(listed, "node long, dim int, vector binary, weight long, filters array<long>")
    listed_rows = stage(listed_rows, "filters")
    sizes = listed_rows.select(F.explode("filters").alias("filter")).groupBy("filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    thin = listed_rows.select("node", F.explode("filters").alias("filter")).join(sizes, "filter")
    placed = thin.join(listed_rows, "node").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    before = F.filter("filters", lambda f: f < F.col("filter"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("before", before)
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("filter", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "dim", "weight", "vector", "before")
    found = stage(cells.groupBy("filter", "low", "high").applyInPandas(_verify(limit), "u long, v long, n long"), "near-vectors")

    links = found.where("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    components = connected_components(found.where("n < 0").select("u", "v"))
    merged = reps.select("key", "id", "node", "weight").join(links, "node", "left").join(components, "node", "left")
    merged = merged.withColumn("component", F.coalesce("component", "node"))
    least = merged.groupBy("component").agg(F.min("id").alias("least"))
    merged = merged.join(least, "component").select(F.col("key").alias("of"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "least")
    # a vector that links with nothing has a key of its own, so that these do not meet in one task
    own = F.coalesce("key", F.concat(F.lit("none"), F.col("id").cast("string")).cast("binary"))
    out = rows.select("id", own.alias("of")).join(merged, "of", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "id").alias("component"))
