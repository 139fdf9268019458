"""The registered queries of op3 and op5 against whole-text encoding, and what the packing search holds and reaches."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from hubbub.llm import packing, queries, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoded(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids for r in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3_gives_starts_lengths_and_checksums(spark, encoded):
    at, want = 0, []
    for doc_id in sorted(encoded):
        ids = [*encoded[doc_id], 0]
        want.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op3_token_codes(spark, SF).collect()) == want


def test_op5_places_every_id_once_and_gapless(spark, encoded):
    pieces = queries.op5_packing(spark, SF).collect()
    next_start, next_offset = Counter(), Counter()
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = [*encoded[p.doc_id], 1]
        assert p.start == next_start[p.doc_id] and p.doc_tokens == len(ids) and p.length > 0
        assert p.ids_crc32 == crc(ids[p.start : p.start + p.length])
        next_start[p.doc_id] += p.length
    assert next_start == {d: len(ids) + 1 for d, ids in encoded.items()}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == next_offset[p.sequence_id]
        next_offset[p.sequence_id] += p.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in next_offset.values())


def packed(lengths, block=1 << 22):
    """The pieces of documents of these lengths, and the most tokens that were held."""
    packer, most = packing._Packer(2048, 0), 0
    for i, n in enumerate(lengths):
        packer.add(i, bytes(4 * n))
        most = max(most, packer.tokens)
        if packer.tokens >= block:
            packer.fill()
            packer.settle(block // 2)
    packer.fill()
    packer.finish()
    assert not packer.held and not packer.tokens and sum(p[2] for p in packer.out) == sum(lengths)
    return packer.out, most


@pytest.mark.parametrize("stuck", [2047, 2046])
@pytest.mark.parametrize("parts", [1, 8])
def test_the_search_places_nearly_all_remainders(stuck, parts):
    rng, how = random.Random(5), Counter()
    for _ in range(parts):
        for p in packed([stuck, *(int(rng.lognormvariate(6, 1)) + 1 for _ in range(4000 // parts))])[0]:
            how[p[7]] += p[2]
    assert how["search"] > 0.99 * (how["search"] + how["cut"])


def test_lengths_without_partners_stay_bounded():
    pieces, most = packed([1500] * 3000, block=1 << 18)
    assert most < (1 << 18) + 2048
    fill = Counter()
    for p in pieces:
        fill[p[5]] += p[2]
    assert sum(n == 2048 for n in fill.values()) == 1500 * 3000 // 2048


def test_pairs_beside_one_long_remainder():
    pieces, _ = packed([2000] + [1024] * 2000)
    how = Counter(p[7] for p in pieces)
    assert how["search"] >= 1999 and how["cut"] <= 12


def test_frequent_words_are_encoded_once_among_rare_ones():
    encoder, calls = tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), memory=400), Counter()
    model = encoder.model

    class Counting:
        def tokenize(self, piece):
            calls[piece] += 1
            return model.tokenize(piece)

    encoder.model = Counting()
    letters = "abcdefghijklmnopqrst"
    for i in range(100):
        common, rare = [f"common{x}" for x in letters], [f"rare{letters[i // 10]}{letters[i % 10]}{x}," for x in letters]
        text = " ".join(["start", *common, *rare])
        assert encoder.encode([text]) == encoder._whole([text])
    assert {calls[f"\u0120common{x}"] for x in letters} == {1} and sum(calls.values()) < 2100
    assert max(map(len, (encoder.first, encoder.later, encoder.pieces))) <= 400


@pytest.mark.parametrize("part", [1, 40, 1 << 23])
def test_arrow_texts_encode_in_order_whatever_the_parts(monkeypatch, part):
    monkeypatch.setattr(tokens, "PART", part)
    encoder = tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), memory=3)
    texts = ["", "a b\nc d, e.", "two  blanks", "é ß, x.", "", "日 b", "b, b. b! it's 1,000 ...", "a\x1fb", "<|endoftext|> a", "x.\ny"] * 20
    for chosen in (texts[3:], texts[:1], texts[2:3], []):
        assert encoder.encode(pa.array([*texts[:3], *chosen], pa.string()).slice(3)) == encoder._whole(chosen)
