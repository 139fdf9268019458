"""Clusters around centroids by a vector-approximation file.

A vector becomes integers, floor(scale * x), and is kept twice: whole, and as a cell number of few bits for each
component. Cells are cut at quantiles of a normal curve with the component's mean and deviation, each cell's smallest
and largest member value being known from all rows. For each round a lookup table gives, for every centroid, component
and cell, the least and the most that the component adds to the squared distance. Summed, they bound the distance to
each centroid. The vector's own squared length about the mean is the same in all its distances, so it is left out of
them, which makes the intervals much narrower. A centroid whose least is above another's most cannot be the nearest. One centroid left decides the
row from its cells alone. Only where intervals overlap the whole vector is fetched, and the exact distance to the
centroids left decides, ties going to the smaller number.

The first and the last assignment need whole vectors in any case, one for the sums and one for the distances, and read
them beside the cells. The rounds between read cells only, and fetch by a join the vectors whose intervals overlap or
that change their cluster: sums are carried on by what leaves and joins a cluster, so they stay exact. A task sends one
row for each cluster, so a cluster of a third of all rows is no group of rows anywhere.

All arithmetic is on integers. Vectors that are null, not of exactly `dim` components, or hold null or non-finite
components are left out. Integers are limited to 2**26 either way, beyond which a squared distance would not fit a long.
Rows that repeat, or share an id, are rows of their own; a null id starts a centroid only if too few others can.
Fewer vectors than centroids give fewer centroids, an empty table no rows. Other columns are not read, so their names
cannot clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubbub.llm.common import stage

#: Integers beyond this are limited to it.
LARGEST = 1 << 26
_STATE = "node long, cells binary, cluster int, of int, n long, sums array<long>"
_STATE_ARROW = pa.schema([("node", pa.int64()), ("cells", pa.binary()), ("cluster", pa.int32()), ("of", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


@dataclass(frozen=True)
class Plan:
    """k centroids after `rounds` updates of vectors of `dim` components, in cells of up to 8 bits."""

    k: int = 16
    rounds: int = 3
    dim: int = 64
    scale: int = 64
    bits: int = 6
    seed: str = "1:"


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), limited."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * vectors), -LARGEST, LARGEST).astype(np.int64)


class Cells:
    """Cell numbers of integer vectors: cuts[c, j] is the smallest value of component c in cell j + 1."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, bits: int):
        if not 0 < bits <= 8:
            raise ValueError("cells take 1 to 8 bits")
        at = [NormalDist().inv_cdf(j / 2**bits) for j in range(1, 2**bits)]
        self.bits, self.cuts = bits, np.ceil(mean[:, None] + deviation[:, None] * np.array(at)).astype(np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cut, column, "right") for cut, column in zip(self.cuts, x.T)], axis=1).astype(np.uint8)


def packed(cells: np.ndarray, bits: int) -> np.ndarray:
    """Cell numbers of so many bits, one behind the other."""
    return np.packbits(np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(cells), -1 if len(cells) else 0), axis=1)


def unpacked(raw: list[bytes], dim: int, bits: int) -> np.ndarray:
    width = (dim * bits + 7) // 8
    each = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), width), axis=1)[:, : dim * bits].reshape(len(raw), dim, bits)
    out = np.zeros((len(raw), dim), np.uint8)
    for b in range(bits):
        out = out << 1 | each[:, :, b]
    return out


class Bounds:
    """The least and the most that each cell adds to the squared distance to each centroid, beside the squared distance to
    the point `middle`. low and high: the smallest and largest value in each cell of each component."""

    def __init__(self, centroids: np.ndarray, low: np.ndarray, high: np.ndarray, middle: np.ndarray):
        c = (centroids - middle)[:, :, None]
        # |x - c|^2 = |x|^2 + sum of c (c - 2 x), linear in x: the extremes are at the ends of a cell
        ends = [c * (c - 2 * (end - middle[:, None])[None]) for end in (low, high)]
        # (component, cell, centroid), so that a look-up gives a row for all centroids
        self.least, self.most = (np.ascontiguousarray(f(*ends).transpose(1, 2, 0)) for f in (np.minimum, np.maximum))

    def open(self, cells: np.ndarray) -> np.ndarray:
        """Which centroids can be the nearest of each row."""
        least = np.zeros((len(cells), self.least.shape[2]), np.int64)
        most = np.zeros_like(least)
        for c in range(cells.shape[1]):
            least += self.least[c, cells[:, c]]
            most += self.most[c, cells[:, c]]
        return least <= most.min(1, keepdims=True)


def nearest(x: np.ndarray, open_: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row among the open ones; distances are only taken where more than one is open."""
    out = open_.argmax(1)
    unsure = np.flatnonzero(open_.sum(1) > 1)
    far = np.iinfo(np.int64).max
    distances = np.full((len(unsure), len(centroids)), far)
    for k, c in enumerate(centroids):
        rows = np.flatnonzero(open_[unsure, k])
        distances[rows, k] = ((x[unsure[rows]] - c) ** 2).sum(1)
    out[unsure] = distances.argmin(1)
    return out


def _whole(raw: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<i4").reshape(-1, dim).astype(np.int64)


class _Gathered:
    """Sums of the vectors that join clusters, less those that leave."""

    def __init__(self, k: int, dim: int):
        self.n, self.sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)

    def add(self, cluster: np.ndarray, x: np.ndarray, sign: int) -> None:
        for k in np.unique(cluster):
            self.n[k] += sign * (cluster == k).sum()
            self.sums[k] += sign * x[cluster == k].sum(0)

    def rows(self) -> pa.RecordBatch:
        k = len(self.n)
        none = [None] * k
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((none, none, none, range(k), self.n, self.sums.tolist()), _STATE_ARROW)], schema=_STATE_ARROW)


def _state(node, cells, cluster) -> pa.RecordBatch:
    n = len(node)
    return pa.RecordBatch.from_arrays([node, cells, pa.array(cluster, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], schema=_STATE_ARROW)


def _kept(table: DataFrame, vector_id: str, vector: str, plan: Plan) -> DataFrame:
    """node (a number of its own for each row), id and vector (integers as bytes) of the vectors that count."""

    def convert(batches):
        for batch in batches:
            x = integers(batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, plan.dim), plan.scale).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([row.tobytes() for row in x], pa.binary())], ["id", "vector"])

    rows = table.select(F.col(vector_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") == plan.dim)).where(finite)
    return rows.mapInArrow(convert, "id long, vector binary").select(F.monotonically_increasing_id().alias("node"), "id", "vector")


def _moments(rows: DataFrame, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations: only where cells are cut depends on them."""

    def sums(batches):
        total = np.zeros(1 + 2 * plan.dim)
        for batch in batches:
            x = _whole(batch["vector"].to_pylist(), plan.dim).astype(float)
            total += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    parts = rows.select("vector").mapInArrow(sums, "sums array<double>").select(F.posexplode("sums").alias("at", "value"))
    total = np.zeros(1 + 2 * plan.dim)
    for at, value in parts.groupBy("at").agg(F.sum("value")).collect():
        total[at] = value
    n, one, two = max(1.0, total[0]), total[1 : plan.dim + 1], total[plan.dim + 1 :]
    return one / n, np.sqrt(np.maximum(two / n - (one / n) ** 2, 0))


def _with_cells(rows: DataFrame, cells: Cells, plan: Plan) -> DataFrame:
    def convert(batches):
        for batch in batches:
            found = packed(cells.of(_whole(batch["vector"].to_pylist(), plan.dim)), plan.bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([row.tobytes() for row in found], pa.binary())], ["node", "id", "vector", "cells"])

    return rows.mapInArrow(convert, "node long, id long, vector binary, cells binary")


def _ranges(rows: DataFrame, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value in each cell of each component; a cell without rows has none and adds nothing."""
    size = 1 << plan.bits
    slots = np.arange(plan.dim) * size

    def ranges(batches):
        low, high = np.full(plan.dim * size, LARGEST), np.full(plan.dim * size, -LARGEST)
        for batch in batches:
            x = _whole(batch["vector"].to_pylist(), plan.dim).ravel()
            at = (unpacked(batch["cells"].to_pylist(), plan.dim, plan.bits) + slots).ravel()
            np.minimum.at(low, at, x)
            np.maximum.at(high, at, x)
        at = np.flatnonzero(low <= high)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (at, low[at], high[at])], ["at", "low", "high"])

    low, high = np.zeros(plan.dim * size, np.int64), np.zeros(plan.dim * size, np.int64)
    for at, least, most in rows.select("vector", "cells").mapInArrow(ranges, "at long, low long, high long").groupBy("at").agg(F.min("low"), F.max("high")).collect():
        low[at], high[at] = least, most
    return low.reshape(plan.dim, size), high.reshape(plan.dim, size)


def _summed(state: DataFrame, plan: Plan, n: np.ndarray, sums: np.ndarray) -> None:
    """Add to n and sums what the tasks gathered."""
    each = [F.sum(F.col("sums")[c]).alias(f"s{c}") for c in range(plan.dim)]
    for k, more, *values in state.where("of is not null").groupBy("of").agg(F.sum("n"), *each).collect():
        n[k] += more
        sums[k] += values


def cluster(table: DataFrame, plan: Plan = Plan(), *, vector_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster and squared distance of each vector that counts; the final centroids)."""
    rows = stage(_kept(table, vector_id, vector, plan), "integer-vectors")
    order = F.sha2(F.concat(F.lit(plan.seed), F.col("id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "vector").limit(plan.k).collect()
    if not first:
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, plan.dim), np.int64)
    centroids = _whole([bytes(r["vector"]) for r in first], plan.dim)
    mean, deviation = _moments(rows, plan)
    middle = np.rint(mean).astype(np.int64)
    rows = stage(_with_cells(rows, Cells(mean, deviation, plan.bits), plan), "cells")
    low, high = _ranges(rows, plan)
    k, dim = len(centroids), plan.dim
    n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)

    def start(batches):
        bounds, gathered = Bounds(centroids, low, high, middle), _Gathered(k, dim)
        for batch in batches:
            x = _whole(batch["vector"].to_pylist(), dim)
            found = nearest(x, bounds.open(unpacked(batch["cells"].to_pylist(), dim, plan.bits)), centroids)
            gathered.add(found, x, 1)
            yield _state(batch["node"], batch["cells"], found)
        yield gathered.rows()

    def judge(batches):
        """cluster as before, the one that the cells alone decide (-1 if none), and which centroids are open."""
        bounds, bit = Bounds(centroids, low, high, middle), 1 << np.arange(k)
        for batch in batches:
            open_ = bounds.open(unpacked(batch["cells"].to_pylist(), dim, plan.bits))
            sure = np.where(open_.sum(1) == 1, open_.argmax(1), -1)
            columns = [pa.array(sure, pa.int32()), pa.array(open_ @ bit, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["cells"], batch["cluster"], *columns], ["node", "cells", "cluster", "sure", "open"])

    def settle(batches):
        gathered = _Gathered(k, dim)
        for batch in batches:
            x = _whole(batch["vector"].to_pylist(), dim)
            open_ = (batch["open"].to_numpy()[:, None] >> np.arange(k)) & 1 == 1
            before, found = batch["cluster"].to_numpy(), nearest(x, open_, centroids)
            moved = before != found
            gathered.add(before[moved], x[moved], -1)
            gathered.add(found[moved], x[moved], 1)
            yield _state(batch["node"], batch["cells"], found)
        yield gathered.rows()

    def last(batches):
        bounds = Bounds(centroids, low, high, middle)
        for batch in batches:
            x = _whole(batch["vector"].to_pylist(), dim)
            found = nearest(x, bounds.open(unpacked(batch["cells"].to_pylist(), dim, plan.bits)), centroids)
            distance = ((x - centroids[found]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    for r in range(plan.rounds):
        if not r:
            state = stage(rows.select("node", "vector", "cells").mapInArrow(start, _STATE), "round")
        else:
            judged = state.where("node is not null").select("node", "cells", "cluster").mapInArrow(judge, "node long, cells binary, cluster int, sure int, open long")
            judged = stage(judged, "judged")
            fetch = judged.where("sure <> cluster").join(rows.select("node", "vector"), "node")
            sure = judged.where("sure = cluster").select("node", "cells", "cluster", *(F.lit(None).cast(t).alias(c) for c, t in (("of", "int"), ("n", "long"), ("sums", "array<long>"))))
            state = stage(fetch.select("node", "cells", "cluster", "open", "vector").mapInArrow(settle, _STATE).unionByName(sure), "round")
        _summed(state, plan, n, sums)
        centroids = np.where(n[:, None] > 0, np.floor_divide(sums, np.maximum(n, 1)[:, None]), centroids)
    return rows.select("id", "vector", "cells").mapInArrow(last, "id long, cluster int, distance long"), centroids


def centroid_digests(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
