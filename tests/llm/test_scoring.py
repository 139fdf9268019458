"""op6 against a plain re-implementation of its words, vectors, pooling and forward pass; op1's added kinds."""

import re

import numpy as np
import pytest

from hubbub.llm import pii, quality, queries

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1
# what the operator calls a word: a run of letters, digits and bytes of other scripts, or of other signs
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")


def bucket(word: bytes, buckets: int) -> int:
    h, power = 0, 1
    for c in word:
        h = (h + int(quality._BYTE[c]) * power) & MASK
        power = power * int(quality._STEP) & MASK
    h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & MASK
    return (h ^ (h >> 29)) % buckets


def words(text, buckets):
    return [bucket(w, buckets) for w in WORD.findall((text or "").encode().lower())]


@pytest.mark.parametrize("text", ["", " ", "a", "Ab!? c", "日本語" * 40 + "x", "日本語" * 40 + "y", "é" * 200 + " b", "--" * 90 + "a"])
def test_words_count_in_full(text):
    assert quality.word_buckets(text, 1 << 14).tolist() == words(text, 1 << 14)


def test_long_runs_and_slices(monkeypatch):
    monkeypatch.setattr(quality, "_SLICE", 7)
    text = "abc defghijklmnop " + "q" * 50 + "!!" + "日本" * 20 + "   x"
    assert quality.word_buckets(text, 1 << 14).tolist() == words(text, 1 << 14)
    assert quality.word_buckets("日" * 99 + "a", 1 << 14) != quality.word_buckets("日" * 99 + "b", 1 << 14)


def test_op6_equals_a_plain_implementation(spark):
    s = quality.Settings()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = {d: words(t, s.buckets) for d, t in text.items()}
    index, context = quality.Index(s).dense, np.zeros((s.buckets, s.dim))
    for seq in found.values():
        for i, w in enumerate(seq):
            for j in range(max(0, i - s.window), min(len(seq), i + s.window + 1)):
                if j != i:
                    context[w] += index[seq[j]]
    vectors = np.hstack([context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1), index])
    pooled = {d: np.mean([vectors[w] for w in seq], axis=0) if seq else np.zeros(2 * s.dim) for d, seq in found.items()}
    import zlib

    fold = {d: zlib.crc32(str(d).encode()) % 5 for d in {*text, *label}}
    learned = sorted(d for d in label if d in text and fold[d])
    model = quality.Model(s, vectors)
    quality._train(model, np.array([pooled[d] for d in learned]), np.array([label[d] for d in learned], float), np.array([fold[d] == 1 for d in learned]))
    (w1, b1), (w2, b2) = model.layers
    rows = queries.op6_quality(spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        hidden = np.tanh((pooled[r.doc_id] - model.centre) / model.spread @ w1 + b1)
        score = 1 / (1 + np.exp(-np.clip((hidden @ w2 + b2)[0] / model.temperature, -30, 30)))
        assert abs(r.score - score) < 1e-6 and r.held_out == (fold[r.doc_id] == 0) and r.predicted == (r.score >= 0.3)


@pytest.mark.parametrize("text", ["konto GB82 WEST 1234 5698 7654 32 OK THEN", "konto GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432.", "x GB82 WEST 1234 5698 7654 32\nAB"])
def test_iban_by_the_length_of_its_country(text):
    spans = [s for s in pii.find_spans(text) if s[0] == "iban"]
    assert len(spans) == 1 and text[spans[0][1] : spans[0][2]].replace(" ", "") == "GB82WEST12345698765432"


@pytest.mark.parametrize("text", ["GB82 WEST 1234 5698 7654 33", "GB82WEST123456987654321", "ZZ82 WEST 1234 5698 7654 32", "xGB82WEST12345698765432", "GB82 WEST 1234"])
def test_no_iban(text):
    assert not [s for s in pii.find_spans(text) if s[0] == "iban"]


def test_op1_returns_scores_that_context_moves(spark, tmp_path):
    rows = [(1, "card 4111 1111 1111 1111"), (2, "sample 4111 1111 1111 1111"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op1_pii(spark, str(tmp_path)).collect()}
    assert [got[i].scores for i in (1, 2, 3, 4)] == ["1.00", "0.50", "", ""] and got[1].n_card == got[2].n_card == 1
