"""Near duplicates by word shingles: SetSketch registers, a joint likelihood, then the full sets.

Register i of a set holds floor(1 - log_b h), h the smallest of its elements' exponential variables of
rate a, truncated to [0, q + 1]: mergeable by maximum, and equal in two sets with nearly the probability of
their Jaccard similarity as b is near 1. Bands of registers propose buckets. Within a bucket registers are
compared jointly: with D+, D- and D0 registers larger, smaller and equal and both cardinalities known, the
likelihood of J has a maximum; a pair goes on only if J at the threshold or above is not too unlikely. Every
pair that goes on is confirmed on its full shingle sets.

Documents with equal sets are first folded into one representative, known by a number of its own, so a group of copies
costs a row for each task. Representatives that buckets chain together form a group, in which each occurs once however
many buckets it shares. A group is dealt into blocks of bounded size. First each block meets itself and the group's
hub; that joins nearly all of a template's copies at a cost in proportion to their number. What is not yet in the group's
largest class then meets everything outside its own class, block against block, so no link is lost, no group is held
by one task, and members of the largest class never meet each other again. A block tries each row's likely partners from the most
alike on and skips those it has joined already; only a spanning forest of confirmed links leaves it.

Words are runs of non-blank characters with A-Z lower-cased; shingles are held as 64-bit hashes of their words.
A document with fewer words than a shingle is one shingle; one without words (or null) has none and links
with nothing. Repeated rows fold into one representative. Rows that share a doc_id but not the text are documents
of their own; each gets the smallest doc_id of its own class. A null doc_id is no number, so a class has one only if
all of its rows do. Empty tables give no rows. Columns other than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubbub.llm.common import few_at_once, stage, whole_text
from hubbub.llm.components import connected_components

_SLICE = 1 << 20


@dataclass(frozen=True)
class Plan:
    """width: words in a shingle. percent: link at 100 * intersection >= percent * union. A band holds `rows`
    registers; at the threshold of 85 % all of 28 bands miss a pair once in 10**5 to 10**6."""

    width: int = 3
    percent: int = 85
    bands: int = 28
    rows: int = 6
    base: float = 1.001
    rate: float = 20.0
    levels: int = 65534
    unlikely: float = 14.0
    block: int = 512
    seed: int = 11

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(2024)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ORDER = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * _powers[-1:] * _STEP])
    return _powers[:n]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased, slice by slice so that long texts stay small in memory."""
    text, out, at = text.lower(), [], 0
    while at < len(text):
        raw = np.frombuffer(text, np.uint8, min(_SLICE, len(text) - at), at)
        blank = _BLANK[raw]
        if at + len(raw) < len(text):  # up to the last blank; a word longer than a slice is taken whole
            cut = np.flatnonzero(blank)
            if len(cut):
                raw, blank = raw[: cut[-1] + 1], blank[: cut[-1] + 1]
            else:
                rest = _BLANK[np.frombuffer(text, np.uint8, len(text) - at, at)]
                n = int(rest.argmax()) if rest.any() else len(rest)
                raw, blank = np.frombuffer(text, np.uint8, n, at), np.zeros(n, bool)
        at += len(raw)
        inside = ~blank
        starts = np.flatnonzero(inside & np.concatenate([[True], blank[:-1]]))
        if not len(starts):
            continue
        gaps = np.diff(np.append(starts, len(raw)))
        place = np.arange(starts[0], len(raw)) - np.repeat(starts, gaps)
        values = np.where(inside[starts[0] :], _BYTE[raw[starts[0] :]] * _power(int(gaps.max()))[place], np.uint64(0))
        out.append(_mix(np.add.reduceat(values, starts - starts[0])))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str, width: int) -> np.ndarray:
    """The distinct shingles, sorted."""
    words = word_hashes(text.encode())
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    mixed = np.full(n, width, np.uint64)
    for i in range(width):
        mixed = _mix(mixed + words[i : i + n] * _ORDER[i % 64])
    return np.unique(mixed)


class Sketcher:
    def __init__(self, plan: Plan):
        self.plan = plan
        rng = np.random.default_rng(plan.seed)
        self.factors = rng.integers(1, 1 << 63, plan.registers, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.bands = rng.integers(1, 1 << 63, (plan.bands, plan.rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def registers(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(self.plan.registers, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 256):
            np.minimum(low, (shingles[i : i + 256, None] * self.factors).min(0), out=low)
        h = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / self.plan.rate
        h = np.maximum(h, 1e-300)
        return np.clip(np.floor(1 - np.log(h) / np.log(self.plan.base)), 0, self.plan.levels + 1).astype(np.uint16)

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        parts = registers.reshape(self.plan.bands, self.plan.rows).astype(np.uint64)
        return _mix((_mix(parts + np.uint64(1)) * self.bands).sum(1, dtype=np.uint64)).view(np.int64)


_SHARES = np.linspace(0.02, 1.0, 50)


def likely(larger: np.ndarray, equal: np.ndarray, registers: int, n_u: np.ndarray, n_v: np.ndarray, plan: Plan) -> np.ndarray:
    """Which pairs keep a likelihood within `unlikely` of its maximum at some J of the threshold or above."""
    u = n_u / (n_u + n_v)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    smaller = registers - larger - equal
    b = plan.base

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (b - 1) / b) / np.log(b)

    def log_likelihood(j):
        up, down = np.maximum(p(u - v * j), 1e-9), np.maximum(p(v - u * j), 1e-9)
        return larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-9))

    # all shares in one array: most calls have few pairs
    j = most * _SHARES[:, None]
    values = log_likelihood(j)
    top = values.max(0)
    best = np.where(j >= plan.percent / 100 - 1e-9, values, -np.inf).max(0)
    at_threshold = log_likelihood(np.minimum(most, plan.percent / 100))
    best = np.where(most * 100 >= plan.percent - 1e-9, np.maximum(best, at_threshold), -np.inf)
    return best >= np.maximum(top, best) - plan.unlikely


def sketches(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (of the set; null if empty), registers and band keys."""

    def sketch(batches):
        sketcher = Sketcher(plan)
        for batch in few_at_once(batches):
            sizes, digests, registers, keys = [], [], [], []
            for text in batch["text"].to_pylist():
                shingles = shingle_set(text, plan.width)
                sizes.append(len(shingles))
                if len(shingles):
                    r = sketcher.registers(shingles)
                    digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    registers.append(r.tobytes())
                    keys.append(sketcher.band_keys(r))
                else:
                    digests.append(None)
                    registers.append(None)
                    keys.append(None)
            columns = [batch["doc_id"], batch["text_hash"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "digest", "registers", "keys"])

    return _texts(docs).mapInArrow(sketch, "doc_id long, text_hash long, n_shingles long, digest binary, registers binary, keys array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    text = whole_text(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _sets(docs: DataFrame, wanted: DataFrame, plan: Plan) -> DataFrame:
    """node and shingles of each wanted representative (doc_id, text_hash, node, digest)."""

    def sets(batches):
        seen = set()  # a row that is repeated very often leaves a task once
        for batch in few_at_once(batches):
            nodes, found = [], []
            for text, node, digest in zip(*(batch[c].to_pylist() for c in ("text", "node", "digest"))):
                if node in seen:
                    continue
                shingles = shingle_set(text, plan.width)
                if hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() == digest:
                    seen.add(node)
                    nodes.append(node)
                    found.append(shingles.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    wanted = wanted.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"), "node", "digest")
    rows = _texts(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash")))
    return rows.select("text", "node", "digest").mapInArrow(sets, "node long, shingles array<long>")


def _shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of narrow incidence matrices."""
    every = np.concatenate([*a, *b])
    names, at = np.unique(every, return_inverse=True)
    sizes = [len(x) for x in (*a, *b)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    common = np.flatnonzero(np.bincount(at) > 1)
    column = np.full(len(names), -1)
    column[common] = np.arange(len(common))
    at = column[at]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(common), 4096):
        i, j = np.searchsorted(at, (low, low + 4096))
        part = np.zeros((len(sizes), 4096), np.float32)
        part[owner[i:j], at[i:j] - low] = 1
        out += part[: len(a)] @ part[len(a) :].T
    return out.astype(np.int64)


def _links(a: pd.DataFrame, b: pd.DataFrame, same: bool, plan: Plan) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks (or within one) that join different labels."""
    ra, rb = (np.frombuffer(b"".join(x.registers), np.uint16).reshape(len(x), plan.registers) for x in (a, b))
    na, nb = a.n_shingles.to_numpy().astype(float), b.n_shingles.to_numpy().astype(float)
    ids_a, ids_b, sets_a, sets_b = a.node.to_numpy(), b.node.to_numpy(), list(a.shingles), list(b.shingles)
    label = a.label.to_numpy() if same else np.concatenate([a.label.to_numpy(), b.label.to_numpy()])
    label, shift = label.copy(), 0 if same else len(a)
    counts, tested, out = None, 0, []
    for i in range(len(a)):
        equal = (ra[i] == rb).sum(1)
        near = (equal * 100 >= plan.registers * (plan.percent - 30)) & (label[shift:] != label[i])
        near[: i + 1 if same else 0] = False
        j = np.flatnonzero(near)
        if not len(j):
            continue
        larger = (ra[i] > rb[j]).sum(1)
        j = j[likely(larger, equal[j], plan.registers, np.full(len(j), na[i]), nb[j], plan)]
        for k in j[np.argsort(-equal[j], kind="stable")]:
            if label[i] == label[shift + k]:
                continue
            tested += 1
            if tested == 2000:
                counts = _shared_counts(sets_a, sets_b)
            both = int(counts[i, k]) if counts is not None else len(np.intersect1d(sets_a[i], sets_b[k], assume_unique=True))
            if 100 * both >= plan.percent * (na[i] + nb[k] - both):
                old, new = sorted((label[i], label[shift + k]), reverse=True)
                label[label == old] = new
                out.append((int(ids_a[i]), int(ids_b[k])))
    return out


def _compare(cells: DataFrame, plan: Plan) -> DataFrame:
    """Links (u, v) found in cells (group, low, high): rows of block `low` meet those of block `high`."""

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates("node")
        same = int(cell.low.iloc[0]) == int(cell.high.iloc[0])
        a = cell if same else cell[cell.own == cell.low]
        b = a if same else cell[cell.own == cell.high]
        return pd.DataFrame(_links(a, b, same, plan) if len(a) and len(b) else [], columns=["u", "v"], dtype="int64")

    return cells.groupBy("group", "low", "high").applyInPandas(compare, "u long, v long")


def _within_blocks(members: DataFrame, plan: Plan) -> DataFrame:
    """Each block of a group against itself and the hub, which is the group's smallest node."""
    blocks = F.ceil(F.col("n") / plan.block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    places = F.when(F.col("node") == F.col("group"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
    cells = members.withColumn("own", F.explode(places)).withColumn("label", F.col("node"))
    return _compare(cells.withColumn("low", F.col("own")).withColumn("high", F.col("own")), plan)


def _between_classes(members: DataFrame, plan: Plan) -> DataFrame:
    """members with label, the class that each is in so far: what is outside a group's largest class against all that is in
    other classes. Blocks of the others are numbered first, those of the largest class after them."""
    sizes = members.groupBy("group", "label").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.groupBy("group").agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("n")).where("n > top.size")
    top = stage(top.select("group", F.col("top.label").alias("most"), *(F.ceil(x / plan.block).cast("int").alias(name) for name, x in (
        ("few_blocks", F.col("n") - F.col("top.size")), ("most_blocks", F.col("top.size"))
    ))), "classes")
    rows, most = members.join(top, "group"), F.col("label") == F.col("most")
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.withColumn("own", F.when(most, F.col("few_blocks") + at(F.col("most_blocks"))).otherwise(at(F.col("few_blocks"))))
    last = F.when(most, F.col("few_blocks")).otherwise(F.col("few_blocks") + F.col("most_blocks")) - 1
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return _compare(cells.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "most", "few_blocks", "most_blocks"), plan)


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, text_hash, n_shingles, component (the smallest doc_id reachable) and first for each row of docs (doc_id,
    text). first: true for the rows of one doc_id and text of each class, those of its smallest doc_id."""
    sketched = stage(sketches(docs, plan), "sketches")
    parts = ["doc_id", "text_hash", "n_shingles", "registers", "keys"]
    reps = sketched.where("digest is not null").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), *parts)).alias("rep"))
    reps = stage(reps.select(F.monotonically_increasing_id().alias("node"), "digest", *(f"rep.{c}" for c in parts)), "representatives")

    banded = reps.select("node", F.posexplode("keys").alias("band", "key"))
    banded = banded.select(F.xxhash64("band", "key").alias("bucket"), "node")
    mark = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")
    buckets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub"), mark).where("n > 1")
    # buckets of other bands with the same members add nothing
    buckets = stage(buckets.groupBy("n", "hub", "mark").agg(F.min("bucket").alias("bucket")), "buckets")
    hubs = banded.join(buckets.select("bucket", "hub"), "bucket").where("node <> hub")
    groups = connected_components(hubs.select(F.col("hub").alias("u"), F.col("node").alias("v"))).withColumnRenamed("component", "group")
    sizes = stage(groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    groups = groups.join(sizes, "group").join(reps.drop("keys"), "node")
    groups = stage(groups, "groups")
    sets = stage(_sets(docs, groups, plan), "shingle-sets")
    drawn = groups.select("node", "group", "n", "n_shingles", "registers").join(sets, "node")
    links = stage(_within_blocks(drawn, plan), "links")
    found = connected_components(links)
    large = F.col("n") > plan.block
    if not sizes.where(large).isEmpty():
        members = drawn.where(large).join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        found = connected_components(links.unionByName(stage(_between_classes(members, plan), "links")))

    own_id = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    joined = found.join(reps.select("node", own_id.alias("id")), "node")
    least = stage(joined.groupBy("component").agg(F.min("id").alias("least")), "least")
    named = joined.join(least, "component").select("node", "least")
    placed = reps.join(named, "node", "left").select(F.col("digest").alias("of"), F.coalesce("least", own_id).alias("least"))
    # a document without shingles has a key of its own, so that these do not meet in one task
    own = F.coalesce("digest", F.concat(F.lit("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = sketched.select("doc_id", "text_hash", "n_shingles", own.alias("of")).join(placed, "of", "left")
    first = F.col("least").isNull() | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash")))
    component = F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return rows.select("doc_id", "text_hash", "n_shingles", component.alias("component"), first.alias("first"))
