"""A quality score for documents from random-indexing word vectors and a small network.

Every word (a run of letters and digits, or of signs) falls into one of `buckets`; each bucket has a fixed
sparse random index vector. One pass over all documents adds, to every word's context vector, the index vectors of
the words near it: integer sums, so their order does not matter. A document is the mean of its words' context
vectors and of their index vectors. A two-layer network in numpy, fitted on labelled documents, scores it, and
a temperature fitted on labelled documents kept apart makes the scores probabilities.

The fit takes at most max_labelled labelled rows, those with the smallest hashes of doc_id; the vectors take every
document. Only the text enters a score. Null and empty texts are the zero vector and get a score too. Without both
labels the score is the share of label 1, or 0.5. Equal texts get equal scores, wherever they are. Repeated label
rows count once, the larger label wins; rows with a null doc_id or another label do not. Empty tables give no rows.
Columns other than doc_id and text are not read; score passes them through, but for one of the score column's name,
which it replaces (`into` names the column).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from hubbub.llm.common import few_at_once, plain_names, stage, whole_text


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14
    dim: int = 32
    nonzero: int = 4
    window: int = 2
    hidden: int = 24
    epochs: int = 120
    max_labelled: int = 20_000
    seed: int = 3


_CLASS = np.ones(256, np.uint8)  # letters, digits and all bytes of other scripts
_CLASS[[b for b in range(128) if not chr(b).isalnum()]] = 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_rng = np.random.default_rng(77)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 20
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    """The first n powers of _STEP, as many as the longest word so far needs."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * _STEP)])
    return _powers[:n]


def word_buckets(text: str, buckets: int) -> np.ndarray:
    """The bucket of each word, in order; A-Z lower-cased. All bytes of a word count. Long texts are taken in slices that
    end between words; a word longer than a slice is taken whole."""
    raw, at, out = np.frombuffer(text.encode().lower(), np.uint8), 0, []
    while at < len(raw):
        end = min(len(raw), at + _SLICE)
        while end < len(raw):
            kind = _CLASS[raw[at : end + 1]]
            cuts = np.flatnonzero(kind[1:] != kind[:-1])
            if len(cuts):
                end = at + int(cuts[-1]) + 1
                break
            end = min(len(raw), end + _SLICE)
        part, at = raw[at:end], end
        kind = _CLASS[part]
        starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        gaps = np.diff(np.append(starts, len(part)))
        place = np.arange(len(part)) - np.repeat(starts, gaps)
        words = kind[starts] > 0
        h = np.add.reduceat(np.where(kind > 0, _BYTE[part] * _power(int(gaps.max()))[place], np.uint64(0)), starts)[words]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(((h ^ (h >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Index:
    """The index vectors: `nonzero` places with a sign for each bucket."""

    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.places = rng.integers(0, s.dim, (s.buckets, s.nonzero))
        self.signs = rng.choice([-1, 1], (s.buckets, s.nonzero))
        self.dense = np.zeros((s.buckets, s.dim))
        np.add.at(self.dense, (np.arange(s.buckets)[:, None], self.places), self.signs)


def context_sums(docs: DataFrame, s: Settings) -> np.ndarray:
    """The context vectors of all buckets over all documents: buckets x dim, whatever the size of the corpus."""
    names = [f"c{i}" for i in range(s.dim)]

    def add(batches):
        index, total = Index(s), np.zeros(s.buckets * s.dim, np.int64)

        def near(words: np.ndarray, others: np.ndarray):
            for k in range(s.nonzero):
                flat = words * s.dim + index.places[others, k]
                total[:] += np.rint(np.bincount(flat, index.signs[others, k], len(total))).astype(np.int64)

        def flush(held: list[np.ndarray]):
            # a document's last words must not be next to another one's first
            apart = np.full(s.window, -1)
            words = np.concatenate([x for w in held for x in (w, apart)])
            for o in range(1, s.window + 1):
                a, b = words[:-o], words[o:]
                ok = (a >= 0) & (b >= 0)
                near(a[ok], b[ok])
                near(b[ok], a[ok])

        held, n = [], 0
        for batch in few_at_once(batches):
            for text in batch["text"].to_pylist():
                held.append(word_buckets(text, s.buckets))
                n += len(held[-1])
                if n > 1 << 20:
                    flush(held)
                    held, n = [], 0
        if held:
            flush(held)
        sums = total.reshape(s.buckets, s.dim)
        rows = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(sums[rows, i]) for i in range(s.dim))], ["bucket", *names])

    schema = ", ".join(["bucket int", *(f"{c} long" for c in names)])
    parts = docs.select(whole_text(F.col("text")).alias("text")).mapInArrow(add, schema)
    table = parts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    out = np.zeros((s.buckets, s.dim))
    out[table["bucket"].to_numpy()] = np.column_stack([table[c].to_numpy() for c in names])
    return out


@dataclass
class Model:
    settings: Settings
    vectors: np.ndarray  # buckets x 2 dim: unit context vector, index vector
    layers: list = field(default_factory=list)
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    temperature: float = 1.0
    prior: float = 0.5

    def pooled(self, text: str) -> np.ndarray:
        words = word_buckets(text, self.settings.buckets)
        if not len(words):
            return np.zeros(self.vectors.shape[1])
        times = np.bincount(words, minlength=self.settings.buckets)
        used = np.flatnonzero(times)
        return times[used] @ self.vectors[used] / len(words)

    def logits(self, x: np.ndarray) -> np.ndarray:
        (w1, b1), (w2, b2) = self.layers
        return (np.tanh((x - self.centre) / self.spread @ w1 + b1) @ w2 + b2)[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _train(model: Model, x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> None:
    """Adam on the rows that are not apart, the temperature on those that are."""
    s, rng = model.settings, np.random.default_rng(model.settings.seed + 1)
    model.prior = float(y.mean()) if len(y) else 0.5
    fit = ~apart if 0 < y[~apart].sum() < (~apart).sum() else np.ones(len(y), bool)
    if not 0 < y[fit].sum() < fit.sum():
        return
    xf, yf = x[fit], y[fit]
    model.centre, model.spread = xf.mean(0), xf.std(0) + 1e-6
    z = (xf - model.centre) / model.spread
    params = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], s.hidden)), np.zeros(s.hidden), rng.normal(0, s.hidden**-0.5, (s.hidden, 1)), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(s.epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 256):
            rows = order[at : at + 256]
            h = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            d = (p - yf[rows, None]) / len(rows)
            dh = d @ params[2].T * (1 - h * h)
            grads = [z[rows].T @ dh + 1e-4 * params[0], dh.sum(0), h.T @ d + 1e-4 * params[2], d.sum(0)]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.layers = [(params[0], params[1]), (params[2], params[3])]
    if apart.any():
        logit, t = model.logits(x[apart]), np.exp(np.linspace(-2, 3, 101))
        loss = [np.mean(np.logaddexp(0, np.where(y[apart] == 1, -1, 1) * logit / k)) for k in t]
        model.temperature = float(t[int(np.argmin(loss))])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """labels: doc_id, label (0 or 1), of which the caller has left out what must not be learned."""
    sums = context_sums(docs, settings)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    model = Model(settings, np.hstack([sums / np.maximum(length, 1), Index(settings).dense]))
    chosen = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_labelled)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def pool(batches):
        for batch in few_at_once(batches):
            found = [shared.value.pooled(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(found, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    # at most max_labelled ids
    rows = docs.join(F.broadcast(stage(chosen, "labelled")), "doc_id").select("doc_id", "label", whole_text(F.col("text")).alias("text"))
    table = rows.mapInArrow(pool, "doc_id long, label int, x array<double>").select("*", (fold(F.col("doc_id")) == 1).alias("apart")).toArrow().sort_by("doc_id")
    x = np.array(table["x"].to_pylist(), float).reshape(-1, model.vectors.shape[1])
    _train(model, x, table["label"].to_numpy().astype(float), table["apart"].to_numpy(zero_copy_only=False).astype(bool))
    return model


def score(docs: DataFrame, model: Model, *, into: str = "score") -> DataFrame:
    """docs with the score column `into`."""
    columns, schema, names = plain_names(docs, ("text", into))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in few_at_once(batches):
            x = np.array([shared.value.pooled(t or "") for t in batch["text"].to_pylist()]).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(x))], [*batch.schema.names, "score"])

    rows = docs.select(*columns, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, StructType([*schema, *rows.schema.fields[-1:]]).add("score", DoubleType())).toDF(*names, "text", into)
