"""Phrases: against plain counting, sliced texts, failures of the sample, odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hubbub.llm import phrases

DOCS = "doc_id long, text string, lang string"


def plain(rows, plan):
    """[(lang, rank, phrase, a, l, r, n, score)] by counting everything."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, plan.longest + 1) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if a >= plan.least}
    out = defaultdict(list)
    for (lang, *w), a in often.items():
        if len(w) < 2:
            continue
        longer = [q for q in often if q[0] == lang and len(q) - 1 > len(w) and often[q] >= a and any(list(q[1 + i : 1 + i + len(w)]) == w for i in range(len(q) - len(w)))]
        if not longer:
            s, _, l, r = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
            out[lang].append((-s, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[: plan.top], 1))


def corpus(seed, docs=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Été", "naïve", "x y", "THE", "the"]
    fixed = [" ".join(rng.choices(words, k=k)) for k in (3, 5, 7)]
    rows = []
    for i in range(docs):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choices(words, weights=range(len(words), 0, -1))[0] for _ in range(rng.randint(0, 40))]
        rows.append((i, "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for p in parts), rng.choice(["en", "de", None])))
    return rows + [(None, None, "en"), (500, "", None), (501, "... ,,, \t", "und"), (502, "the the the the the the", "en"), (1, rows[1][1], rows[1][2])]


def check(spark, rows, plan, parts=4):
    out = phrases.collocations(spark.createDataFrame(rows, DOCS).repartition(parts), plan).collect()
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in out) == plain(rows, plan)
    return out


@pytest.mark.parametrize(("plan", "seed"), [(phrases.Plan(least=12, top=40, chunk=150, held=100, names=20), 1), (phrases.Plan(least=4, sample_of=50, longest=4, filter_bits=12), 2)])
def test_phrases_equal_plain_counting(spark, plan, seed):
    assert check(spark, corpus(seed), plan)


def test_border_failures_are_made_good(spark):
    """A sample that misses everything proposes nothing; each pass then adds a word of length."""
    rows = [(i, "alpha beta gamma delta epsilon zeta. one two", "en") for i in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    found, passes = phrases.frequent_phrases(docs, phrases.Plan(least=20, sample_of=10**9))
    assert passes == 5 and found.where("phrase is not null").count() == 6 + 5 + 4 + 3 + 2 + 3
    assert phrases.frequent_phrases(docs, phrases.Plan(least=20, sample_of=1))[1] == 1
    check(spark, rows, phrases.Plan(least=20, sample_of=10**9))


def test_slices_give_the_words_of_the_whole(spark):
    rng = random.Random(5)
    for _ in range(200):
        raw = "".join(rng.choice(["a", "bb", "ccc" * rng.randint(1, 9), " ", " ", "\t", ".", "\n", "é"]) for _ in range(rng.randint(1, 60))).encode()
        whole, parts = Counter(), Counter()
        for where, cut in ((whole, [(raw, 0)]), (parts, phrases.slices(raw, 7, 4))):
            for part, skip in cut:
                chunk = phrases.words_of([("en", part)], skip)
                for n, at, _, _ in phrases.counted(chunk, 5, 0, None):
                    where.update(chunk.phrase(i, n) for i in at.tolist())
        assert whole == parts, raw
    long = "alpha beta gamma " * 3000
    check(spark, [(1, long, "en"), (2, "x" * 9000 + " " + long, None)], phrases.Plan(least=50, chunk=1000))


def test_filters_admit_all_that_they_hold(spark):
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    table = spark.createDataFrame([(int(x),) for x in h[:2500].view(np.int64)], "h long")
    plan = phrases.Plan(filter_bits=18)
    bits = phrases.filter_of(table, plan)
    assert phrases.admits(bits, h[:2500]).all() and phrases.admits(bits, h[2500:]).mean() < 0.01
    both = phrases.filter_of(spark.createDataFrame([(int(h[4000].view(np.int64)),)], "h long"), plan, bits)
    assert phrases.admits(both, h[:2500]).all() and phrases.admits(both, h[4000:4001]).all()


def test_empty_tables_and_clashing_names(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).collect() == []
    rows = spark.createDataFrame([(i, "a b", "en", 1, 2) for i in range(5)], DOCS + ", n int, h int")
    assert [(r.phrase, r.a) for r in phrases.collocations(rows, phrases.Plan(least=5)).collect()] == [("a b", 5)]
