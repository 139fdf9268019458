"""Each stage against brute force or its operator, and on nulls, empties, repeats and clashing names."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
import public_tokenizers
from hubbub.llm import quality
from tests.llm.test_mixing import brute
from tests.llm.test_operators import SF, brute_components

STAGES = dict(p.STAGES)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "score size u k rank copies copy of bitmap n_lines n_dropped lines dropped text_hash node first component numbered `a.b`".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pieces_hold(rows, pieces):
    """Every copy of every document lies in exactly one run of pieces."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, got = Counter(), Counter()
    for doc_id, text in rows:
        for i, x in enumerate([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]):
            want[doc_id, i, x] += 1
    for r in pieces:
        for i, x in enumerate(np.frombuffer(r.ids, "<u4").tolist()):
            got[r.doc_id, r.start + i, x] += 1
    assert got == want
    fill = Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in fill.values())


def test_stages_against_brute_force(spark, docs):
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "quality AS label").where("crc32(cast(doc_id as string)) % 5 <> 0"))
    good = {r.doc_id for r in docs.collect() if model.scores(model.pooled(r.text or "")[None])[0] >= 0.3}
    kept = STAGES["quality"](spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good and 0 < len(good) < docs.count()

    texts = {r.doc_id: r.text or "" for r in kept.collect()}
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for d, t in texts.items():
        for x in t.split("\n"):
            holders[key(x)].add(d)
    stays = lambda d, x: len(key(x)) < 40 or len(holders[key(x)]) < 5 or d == max(holders[key(x)])
    lines = STAGES["line_dedup"](spark, kept, SF).cache()
    rows = sorted((r.doc_id, r.text) for r in lines.collect())
    assert rows == sorted((d, "\n".join(x for x in t.split("\n") if stays(d, x))) for d, t in texts.items())
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    component, _ = brute_components([t for _, t in rows], 5, 80)
    unique = STAGES["near_dedup"](spark, lines, SF).cache()
    assert sorted((r.doc_id, r.text) for r in unique.collect()) == [x for i, x in enumerate(rows) if component[i] == i]

    mixed = STAGES["mixing"](spark, unique, SF).cache()
    want, _, _ = brute([(r.doc_id, r.text, r.source) for r in unique.collect()])
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, _, n in want if n})
    pieces_hold([(r.doc_id, r.text) for r in mixed.collect()], STAGES["packing"](spark, mixed, SF).collect())


def test_labels_of_held_out_rows_are_not_learned(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "quality AS label")
    assert labels.where(quality.fold(labels.doc_id) == 0).count() > 0


def odd_rows():
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n "), (None, "x " + long), (None, "alone " * 9), (4, long), (5, long + " y"), (6, "one"), (6, "one"), (7, "two"), (7, "three words here")]
    return [(d, t, "en", None if i % 4 == 0 else f"s{i % 2}", 5) for i, (d, t) in enumerate(rows)]


def test_odd_rows_and_clashing_names_in_every_stage(spark, docs):
    plain = spark.createDataFrame(odd_rows(), DOCS)
    clash = plain.select("*", *(F.lit(i).alias(c.strip("`")) for i, c in enumerate(CLASHES)))
    same = lambda df: sorted(repr((r.doc_id, r.text, r.source)) for r in df.collect())
    for name in ("quality", "line_dedup", "near_dedup", "mixing"):
        a, b = (STAGES[name](spark, df, SF) for df in (plain, clash))
        assert b.columns == clash.columns and b.dtypes[5:] == clash.dtypes[5:]
        assert all(list(r)[5:] == list(range(len(CLASHES))) for r in b.collect())
        if name != "mixing":  # where null ids draw their numbers anew
            assert same(a) == same(b)
        if name == "line_dedup":
            assert a.count() == plain.count()
        if name == "near_dedup":
            assert sorted((r.doc_id or 0, r.text) for r in a.where("doc_id >= 4 or doc_id is null").collect()) == [(0, "alone " * 9), (4, " ".join(f"w{i}" for i in range(60))), (6, "one"), (7, "three words here"), (7, "two")]
            assert a.where("doc_id < 4").count() == 3
    pieces_hold([(r[0], r[1]) for r in odd_rows()], STAGES["packing"](spark, clash, SF).collect())


def test_empty_tables_in_every_stage(spark, docs):
    empty = docs.limit(0)
    for name in STAGES:
        out = STAGES[name](spark, empty, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_documents_without_an_id_stay(spark):
    rows = [(i if i % 3 else None, f"text {i} " + " ".join(f"w{i}x{k}" for k in range(30)), "en", "s", 100) for i in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("line_dedup", "near_dedup"):
        docs = STAGES[name](spark, docs, SF)
        assert sorted(r.text for r in docs.collect()) == sorted(r[1] for r in rows)
        assert docs.where("doc_id is null").count() == 10
    mixed = STAGES["mixing"](spark, docs, SF)
    assert mixed.select("text").distinct().count() == 30 and mixed.where("doc_id is null").select("text").distinct().count() == 10
