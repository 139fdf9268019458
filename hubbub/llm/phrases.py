"""Phrases whose words keep together, mined after Toivonen.

A sample of the documents proposes frequent phrases at a lowered count. One pass over all documents then counts these and
their negative border exactly: a phrase is counted if it is a single word or if all but its last word and all but its
first word are both proposed. Border phrases that turn out frequent are failures of the sample; they are proposed too,
and a further pass counts what became countable by that, until no pass finds a failure. A pass adds at least a word of
length, so there are at most `longest` of them. The result does not depend on the sample; only the number of passes does.

Proposed phrases reach the tasks as a Bloom filter of fixed size, whatever their number: what it admits in error is
counted exactly as well, and is dropped for its count. Phrases are 64-bit hashes of language and words, combined in a task
before they are shuffled; two frequent ones whose hashes collide would be counted as one, with a chance of about
F**2 / 2**65 for F frequent phrases. Their words are read at last, from a few documents and, for those that these lack,
from all; so a task sends few names and each once.

A candidate is scored at its weakest cut, floor(1000 a n / (l r)) in decimals of 38 digits. One that a longer candidate
holds with an equal count is dropped; as counts never rise with length, a candidate longer by one word tells. Tops are
taken in two steps, so no task ranks all candidates of a language.

Texts are cut at breaks into pieces and these at blanks into words, A-Z lower-cased; bytes above 127 belong to words.
Texts are read in chunks, longer ones in slices that overlap by the words that a phrase may still need. Null and empty
texts have no words, a null lang is `und`. Repeated rows count again. Ties fall to the phrase in byte order. Empty tables
give no rows. Columns other than doc_id, text and lang are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubbub.llm.common import stage, whole_text
from hubbub.llm.setsketch import _BYTE, _mix, _power

#: What ends a piece, and what parts words within one.
BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(GAPS)], _KIND[list(BREAKS)] = 1, 2
_NEXT = np.uint64(0xD6E8FEB86659FD93)
#: Parts of a language that are ranked apart before its top is taken.
_PARTS = 64


@dataclass(frozen=True)
class Plan:
    """Phrases of 2 to `longest` words with `least` occurrences in a language. The sample is one of `sample_of` documents;
    there a phrase is proposed from `lowered` times its share of `least` on. Names are looked for in one of `named_of`
    documents first. Filters have 2**filter_bits bits."""

    least: int = 100
    longest: int = 5
    top: int = 2000
    sample_of: int = 8
    lowered: float = 0.75
    named_of: int = 32
    filter_bits: int = 26
    chunk: int = 1 << 20
    held: int = 1 << 21
    names: int = 1 << 19


# words of a chunk


def slices(raw: bytes, chunk: int, carried: int) -> Iterator[tuple[bytes, int]]:
    """Parts of a long text and the number of words at their start that the part before has counted."""
    at = done = skip = 0
    last = lambda marks, low, high: max(raw.rfind(bytes([c]), low, high) for c in marks)
    while done < len(raw):
        end = done + chunk
        if end < len(raw):
            end = last(GAPS + BREAKS, done, end) + 1
            if end <= done:  # a word longer than a chunk
                end = min((p for p in (raw.find(bytes([c]), done + chunk) for c in GAPS + BREAKS) if p >= 0), default=len(raw) - 1) + 1
        end = min(end, len(raw))
        yield raw[at:end], skip
        low, at, skip, done = max(last(BREAKS, at, end) + 1, at), end, 0, end
        while skip < carried and (q := len(raw[low:at].rstrip(GAPS))):
            at, skip = max(last(GAPS, low, low + q) + 1, low), skip + 1
        at = at if skip else end


@dataclass
class Chunk:
    """Words of joined texts: bytes, places, pieces, hashes with the language, and how many of the first are counted."""

    raw: bytes
    start: np.ndarray
    stop: np.ndarray
    piece: np.ndarray
    hashes: np.ndarray
    langs: list[str]
    lang: np.ndarray
    skip: int

    def phrase(self, at: int, n: int) -> str:
        return b" ".join([self.raw[a:b] for a, b in zip(self.start[at : at + n].tolist(), self.stop[at : at + n].tolist())]).decode()


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def words_of(texts: list[tuple[str, bytes]], skip: int = 0) -> Chunk:
    """The words of (lang, text) pairs."""
    raw = b"\n".join([t for _, t in texts])
    each = np.frombuffer(raw, np.uint8)
    kind = _KIND[each]
    inside = kind == 0
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    firsts = np.cumsum([0] + [len(t) + 1 for _, t in texts[:-1]])
    lang = np.searchsorted(firsts, start, "right") - 1
    if not len(start):
        empty = np.zeros(0, np.int64)
        return Chunk(raw, empty, empty, empty, np.zeros(0, np.uint64), [x for x, _ in texts], empty, skip)
    longest = int((stop - start).max())
    place = np.arange(start[0], len(each), dtype=np.int32) - np.repeat(start.astype(np.int32), np.diff(np.append(start, len(each))))
    np.minimum(place, longest, out=place)
    values = _BYTE[each[start[0] :]]
    values *= _power(longest + 1)[place]
    values *= inside[start[0] :]
    seeds = np.array([_seed(x) for x, _ in texts], np.uint64)
    hashes = _mix(_mix(np.add.reduceat(values, start - start[0])) + seeds[lang])
    return Chunk(raw, start, stop, np.cumsum(kind == 2, dtype=np.int32)[start], hashes, [x for x, _ in texts], lang, skip)


def chunks(batches, plan: Plan) -> Iterator[Chunk]:
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            raw = text.as_buffer().to_pybytes().lower()  # one text at a time, not a list of all
            if len(raw) > plan.chunk:
                for part, skip in slices(raw, plan.chunk, plan.longest - 1):
                    yield words_of([(lang, part)], skip)
                continue
            held.append((lang, raw))
            size += len(raw)
            if size >= plan.chunk:
                yield words_of(held)
                held, size = [], 0
    if held:
        yield words_of(held)


# filters


def _probes(h):
    """Two places of a hash in a filter, before they are cut to its size."""
    return h, h >> (np.uint64(31) if isinstance(h, np.ndarray) else 31)


def admits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    mask = np.uint64(len(bits) * 64 - 1)
    for p in _probes(h):
        p = p & mask
        out &= (bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


def filter_of(hashes: DataFrame, plan: Plan, before: np.ndarray | None = None) -> np.ndarray:
    """The bits of all hashes `h`, or-ed by Spark: at most 2**filter_bits / 64 rows come to the driver."""
    mask = (1 << plan.filter_bits) - 1
    places = [F.shiftrightunsigned("h", shift).bitwiseAND(F.lit(mask)) for shift in (0, 31)]
    rows = hashes.select(F.explode(F.array(*places)).alias("p"))
    word = F.shiftright("p", 6).cast("int").alias("word")
    bit = F.expr("shiftleft(1L, CAST(p & 63 AS INT))")
    found = rows.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros((mask + 1) // 64, np.uint64) if before is None else before.copy()
    bits[found["word"].to_numpy()] |= found["bits"].to_numpy().view(np.uint64)
    return bits


# passes


def counted(chunk: Chunk, longest: int, known: int, new: np.ndarray | None, old: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, places, hashes, which are proposed themselves) of the phrases of each length that are countable under the
    filter `new` and were not under `old`. Of lengths above `known` all countable phrases are taken as proposed."""
    h1 = h = chunk.hashes
    size = len(h1)
    at = np.arange(size)
    proposed = admits(new, h1) if known >= 1 else np.ones(size, bool)
    before = None if old is None else admits(old, h1)
    fresh = slice(None) if old is None else slice(0)
    yield 1, at[chunk.skip :][fresh], h1[chunk.skip :][fresh], proposed[chunk.skip :][fresh]
    for n in range(2, longest + 1):
        if size < n:
            return
        both = proposed[:-1] & proposed[1:]
        if n == 2:
            both &= chunk.piece[:-1] == chunk.piece[1:]
        at = np.flatnonzero(both[: size - n + 1])
        mixed = _mix(h[at] * _NEXT + h1[at + n - 1])
        inside = admits(new, mixed) if n <= known else np.ones(len(at), bool)
        count = at + n - 1 >= chunk.skip
        if before is not None:
            was = before[at] & before[at + 1]
            count &= ~was
            before = np.zeros(size, bool)
            before[at] = was & admits(old, mixed)
        yield n, at[count], mixed[count], inside[count]
        proposed, h = np.zeros(size, bool), np.zeros(size, np.uint64)
        proposed[at], h[at] = inside, mixed


def count_hashes(texts: DataFrame, plan: Plan, lengths: range, known: int, new: np.ndarray | None, old: np.ndarray | None = None) -> DataFrame:
    """n, h, c: occurrences of each countable phrase of these lengths, by task."""
    sc = texts.sparkSession.sparkContext
    new_bits, old_bits = sc.broadcast(new), sc.broadcast(old)

    def flush(parts: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for n in lengths:
            h, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for m, h in parts if m == n)]), return_counts=True)
            for low in range(0, len(h), 1 << 18):
                part = slice(low, low + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[part]), n, np.int32)), pa.array(h[part].view(np.int64)), pa.array(c[part])], ["n", "h", "c"])

    def count(batches):
        parts, held = [], 0
        for chunk in chunks(batches, plan):
            for n, _, h, _ in counted(chunk, lengths[-1], known, new_bits.value, old_bits.value):
                if n in lengths:
                    parts.append((n, h))
                    held += len(h)
            if held >= plan.held:
                yield from flush(parts)
                parts, held = [], 0
        yield from flush(parts)

    # tasks have combined their own counts, so these are dealt by phrase at once, without a second table beside Python's
    return texts.mapInArrow(count, "n int, h long, c long").repartition("n", "h").groupBy("n", "h").agg(F.sum("c").alias("c"))


def name_hashes(texts: DataFrame, plan: Plan, frequent: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """h, lang, phrase of the phrases in the filter `wanted` among those in `frequent`, once for each task, and under a null
    h each language with its number of words, c."""
    sc = texts.sparkSession.sparkContext
    frequent_bits, wanted_bits = sc.broadcast(frequent), sc.broadcast(wanted)
    schema = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("c", pa.int64())])

    def rows(named):
        for low in range(0, len(named), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*named[low : low + (1 << 16)]), schema)], schema=schema)

    def name(batches):
        totals, seen, named = {}, set(), []
        for chunk in chunks(batches, plan):
            for i, n in enumerate(np.bincount(chunk.lang[chunk.skip :], minlength=len(chunk.langs)).tolist()):
                totals[chunk.langs[i]] = totals.get(chunk.langs[i], 0) + n
            for n, at, h, inside in counted(chunk, plan.longest, plan.longest, frequent_bits.value):
                inside = inside & admits(wanted_bits.value, h)  # not in place: longer phrases are built on it
                h, first = np.unique(h[inside], return_index=True)
                for x, i in zip(h.view(np.int64).tolist(), at[inside][first].tolist()):
                    if x not in seen:
                        seen.add(x)
                        named.append((x, chunk.langs[chunk.lang[i]], chunk.phrase(i, n), None))
            if len(named) >= plan.names:
                yield from rows(named)
                named = []
                seen = seen if len(seen) < 8 * plan.names else set()
        yield from rows(named + [(None, lang, None, n) for lang, n in totals.items()])

    return texts.mapInArrow(name, "h long, lang string, phrase string, c long")


def frequent_phrases(docs: DataFrame, plan: Plan = Plan()) -> tuple[DataFrame, int]:
    """(lang, phrase and f of all frequent phrases from one word on, and of all words under a null phrase; passes made)."""
    one_of = lambda salt, n: docs.where(F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id")), F.lit(n)) == 0)
    of = lambda d: d.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), whole_text(F.col("text")).alias("text"))
    texts, sample = of(docs), of(one_of("sample", plan.sample_of))
    from_ = F.col("c") >= max(2, int(plan.lowered * plan.least / plan.sample_of))
    short = stage(count_hashes(sample, plan, range(1, 3), 0, None).where(from_).select("n", "h"), "sample-short")
    proposals = short
    if plan.longest > 2:
        long = count_hashes(sample, plan, range(3, plan.longest + 1), 2, filter_of(short, plan)).where(from_).select("n", "h")
        proposals = short.unionByName(stage(long, "sample-long"))

    new, old, passes, found = filter_of(proposals, plan), None, 0, None
    while True:
        passes += 1
        counts = count_hashes(texts, plan, range(1, plan.longest + 1), plan.longest, new, old).where(F.col("c") >= plan.least)
        counts = stage(counts, "frequent")
        found = counts if found is None else found.unionByName(counts)
        failed = stage(counts.select("n", "h").join(proposals, ["n", "h"], "left_anti"), "border-failures")
        if failed.where(F.col("n") < plan.longest).isEmpty():
            break
        proposals = proposals.unionByName(failed)
        new, old = filter_of(failed, plan, new), new
    # most names come from few documents; what these lack is looked for in all
    frequent, each = filter_of(found, plan), [F.first("lang").alias("lang"), F.first("phrase").alias("phrase")]
    named = stage(name_hashes(of(one_of("names", plan.named_of)), plan, frequent, frequent).where("h is not null").groupBy("h").agg(*each), "names")
    rest = found.join(named.select("h"), "h", "left_anti")
    rest = stage(name_hashes(texts, plan, frequent, filter_of(rest, plan)), "names")
    totals = rest.where("h is null").groupBy("lang").agg(F.lit(None).cast("string").alias("phrase"), F.sum("c").alias("f"))
    named = named.unionByName(rest.where("h is not null").groupBy("h").agg(*each))
    # a hash may be named in both steps, by an error of the filter
    known = found.join(named.groupBy("h").agg(*each), "h").select("lang", "phrase", F.col("c").alias("f"))
    return stage(known.unionByName(totals.select("lang", "phrase", "f")), "named"), passes


def _joined(words: Column, at: Column | int, n: Column) -> Column:
    return F.array_join(F.slice(words, at, n), " ")


def collocations(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first candidates."""
    found, _ = frequent_phrases(docs, plan)
    known = found.where("phrase is not null")
    words = F.split("phrase", " ")
    candidates = known.where(F.size(words) >= 2).select("lang", "phrase", F.col("f").alias("a"), words.alias("words"), F.size(words).alias("size"))

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("words"), 1, F.col("k")).alias("first"), _joined(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    part = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    # as few rows as there are languages, but their number is not bounded, so Spark decides how to join them
    cuts = cuts.join(found.where("phrase is null").select("lang", F.col("f").alias("n")), "lang")
    exact = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {exact('a')} * {exact('n')}) DIV ({exact('l')} * {exact('r')})")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    scored = weakest.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")

    less = F.col("size") - 1
    inner = F.array(_joined(F.col("words"), 1, less), _joined(F.col("words"), 2, less))
    held = candidates.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").distinct()
    scored = scored.join(held, ["lang", "phrase", "a"], "left_anti")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    within = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS))).orderBy(*order)
    scored = scored.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= plan.top)
    scored = scored.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= plan.top)
    return scored.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
