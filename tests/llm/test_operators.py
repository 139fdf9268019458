import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hubbub.llm import exact_dedup, line_dedup, mixing, packing, pii, quality, queries, setsketch, sphere_filters, token_codes, warc
from hubbub.llm.common import fresh_path
from hubbub.llm.tokens import WordEncoder

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta. " * 20_000


def documents(spark, texts):
    return spark.createDataFrame([(i, t, None, f"s{i % 2}" if i % 5 else None, None) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long, equal, one character, foreign scripts."""
    return documents(spark, [None, "", "  \n ", LONG, "a", "A b c", "A b c", "日本語 テスト ½²", "x<|endoftext|>y", "tab\t\ttwo  spaces\r\n"])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(same, name):
    same(queries.queries()[name], queries.ORACLE_SQL[name])


# 1
def brute_pii(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


def test_pii_base_spans_equal_plain_regular_expressions():
    rng = random.Random(1)
    pieces = ["a@b.co", "@", ".", "x.y@z", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-2030", "+12", " ", "-", "0", "77", "é", "a@b.co.@d.ef", "+", "9807915762804490"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE] == brute_pii(text), text
    assert pii.find_spans("1" * 200_000 + "a" * 200_000) == []


def test_pii_checksums_and_context():
    assert [s[0] for s in pii.find_spans("konto GB82 WEST 1234 5698 7654 32")] == ["iban"]
    assert [s[0] for s in pii.find_spans("GB82 WEST 1234 5698 7654 33")] == []
    assert [s[0] for s in pii.find_spans("ssn 123-45-6789")] == ["id_number"] and pii.find_spans("part 123-45-6789") == []
    assert pii.find_spans("call +1 555 010 2030 now")[0][3] > pii.find_spans("see +1 555 010 2030 now")[0][3]


def test_pii_query_counts(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op1_pii(spark, SF).collect():
        want = brute_pii(text[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


# 2
@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates_with_nulls_ties_and_digest_collisions(spark, weak):
    texts = ["a b", "ab", " a b ", None, "", "c", "c", "d", "e"]
    path = fresh_path(spark, "docs")
    frame = documents(spark, texts)
    frame.unionByName(frame.where("doc_id = 7")).write.parquet(path)
    digest = (lambda t: F.lit("x")) if weak else exact_dedup.sha256
    out = exact_dedup.exact_duplicates(spark, path, digest=digest).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out) == [(0, 2, 3), (1, 2, 3), (2, 2, 3), (3, 3, 2), (4, 3, 2), (5, 5, 2), (6, 5, 2), (7, 7, 2), (7, 7, 2), (8, 8, 1)]
    assert sorted(r.doc_id for r in out if r.kept) == [2, 3, 5, 7, 8]


@pytest.mark.parametrize("few", [0, 3, 100])
def test_exact_duplicates_of_a_hot_text_by_broadcast_and_by_shuffle(spark, few):
    path = fresh_path(spark, "docs")
    texts = ["hot text " + " " * (i == 77) for i in range(1500)] + [f"pair {i % 20}" for i in range(40)] + ["alone", "none"]
    documents(spark, texts).withColumn("digest", F.lit("clash")).withColumn("n", F.lit(1)).write.parquet(path)
    out = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(spark, path, few=max(1, few)).collect()}
    assert all(out[i] == (77, 1500) for i in range(1500)) and out[1540] == (1540, 1)
    assert all(out[1500 + i] == (1500 + i % 20, 2) for i in range(40))


def test_exact_duplicates_state_grows_with_new_files(spark):
    path, state = fresh_path(spark, "docs"), fresh_path(spark, "state")
    documents(spark, ["a", "b"]).write.parquet(path)
    exact_dedup.digest_state(spark, path, state)
    documents(spark, ["a", "c"]).write.mode("append").parquet(path)
    assert sorted(r.n for r in exact_dedup.digest_state(spark, path, state).collect()) == [1, 1, 2]


# 3, 5
def test_words_encode_as_whole_texts():
    encoder = WordEncoder(TOKENIZER, memory=50)
    rng = random.Random(2)
    pieces = ["word", "Word,", "it's", " ", "  ", "\n", "\n\n", "12", "é", "½", "\t", "…", "x’s", "<|endoftext|>", "\u0085", "a.b", "日", " a", "b "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    assert encoder.encode(texts) == encoder._whole(texts)


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(0, 300_000, 97))])
def test_codes_round_trip_and_random_access(ids):
    levels = token_codes.encode_levels(np.array(ids, "<u4"))
    assert token_codes.decode_levels(levels).tolist() == ids
    assert [token_codes.token_at(levels, i) for i in range(0, len(ids), max(1, len(ids) // 500))] == ids[:: max(1, len(ids) // 500)]


def whole(texts, end):
    encoder = WordEncoder(TOKENIZER)
    return [np.frombuffer(x, "<u4").tolist() + [end] for x in encoder._whole([t or "" for t in texts])]


def test_token_files_hold_every_id_in_order(spark, odd):
    path = fresh_path(spark, "codes")
    token_codes.write_token_codes(odd, path, tokenizer_path=TOKENIZER, segment_tokens=1000)
    rows = sorted(token_codes.read_documents(token_codes.read_token_codes(spark, path)).collect())
    want = whole([r.text for r in odd.orderBy("doc_id").collect()], 0)
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == want
    assert [r.start for r in rows] == np.cumsum([0, *map(len, want)])[:-1].tolist()


def test_packing_holds_every_id_once_without_padding(spark, odd):
    docs = odd.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(odd.columns).withColumn("doc_id", F.col("doc_id") + 100))
    pieces = packing.pack(docs, tokenizer_path=TOKENIZER, block_tokens=50_000).collect()
    want = dict(zip((r.doc_id for r in docs.orderBy("doc_id").collect()), whole([r.text for r in docs.orderBy("doc_id").collect()], 1)))
    got, fill = {}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == len(got.setdefault(p.doc_id, [])) and p.length == len(p.ids) // 4 and p.doc_tokens == len(want[p.doc_id])
        got[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
    assert got == want
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in fill.values())


def test_closest_fill_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        items = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        counts = {x: items.count(x) for x in items}
        chosen, slack = packing.closest_fill(counts, 40)
        sums = {max(items)}
        rest = sorted(items)[:-1]
        for x in rest:
            sums |= {s + x for s in sums}
        assert 40 - slack == max(s for s in sums if s <= 40) == sum(x * k for x, k in chosen.items())
        assert all(k <= counts[x] for x, k in chosen.items()) and max(items) in chosen


# 4
def test_vectors_link_as_brute_force_with_a_large_group_and_bad_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 64))
    near = base[:40] + rng.normal(size=(40, 64)) * 0.25
    group = base[50] + rng.normal(size=(700, 64)) * 0.2
    x = np.vstack([base, near, group, base[:3], 2 * base[3:4]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, []), (5002, [0.0] * 64), (5003, [float("nan")] * 64), (5004, [None] + [1.0] * 63)]
    out = {r.id: r for r in sphere_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=200).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    found = np.array([out[i].n_links for i in range(len(x))])
    assert found.sum() >= 0.995 * links.sum() and (found <= links).all()
    assert {out[450 + i].component for i in range(0, 690, 50)} == {out[50].component} or out[50].n_links == 0
    assert all(out[i].n_links == 0 and out[i].component == i for i in range(5000, 5005))


def test_vectors_of_each_length_link_among_themselves(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(400, 64))
    near = base[:40] + rng.normal(size=(40, 64)) * 0.1
    short = rng.normal(size=(3, 20))
    vectors = [*base, *near, *short, *(short + 0.01), rng.normal(size=65)]
    out = {r.id: r for r in sphere_filters.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()}
    assert [out[i].n_links for i in range(40)] == [1] * 40 and [out[400 + i].component for i in range(40)] == list(range(40))
    assert [out[443 + i].component for i in range(3)] == [440, 441, 442] and out[446].n_links == 0


# 6
def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op6_quality(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_without_labels_and_with_odd_texts(spark, odd):
    none = spark.createDataFrame([], "doc_id long, label int")
    model = quality.fit(odd, none)
    assert {r.score for r in quality.score(odd, model).collect()} == {0.5}


# 7
def test_mix_reaches_targets_with_a_bound_on_copies(spark):
    rows = mixing.mix(documents(spark, ["w " * (i % 37) for i in range(3000)])).collect()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 37
    assert {r.copies for r in rows} <= {0, 1, 2}


# 9
def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    base = [rng.choices("abcdefghijklmnopqrstuvwxyz", k=150) for _ in range(20)]
    texts = [None, "", "A b", "a  B", "b a", LONG, LONG + "x"]
    for words in base:
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(150)] = "zz" + str(rng.randrange(99))
            texts.append(" ".join(copy))
    out = {r.doc_id: r for r in setsketch.near_duplicates(documents(spark, texts), setsketch.Plan(block=16)).collect()}
    component, sizes = brute_components(texts, 3, 85)
    assert [out[i].n_shingles for i in range(len(texts))] == sizes
    assert [out[i].component for i in range(len(texts))] == component


# 10
@pytest.mark.parametrize("shards", ["2", "8", "31"])
def test_repeated_lines_with_a_hot_line_over_many_partitions(spark, shards):
    rng, pool = random.Random(6), [f"{i} " + "line " * 9 for i in range(12)]
    texts = ["\n".join(["HOT " * 12] * (1 + i % 3) + rng.choices(pool, k=3) + ["short"]) for i in range(200)] + [None, "", "\n"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    docs = documents(spark, texts)
    out = {r.doc_id: r for r in line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    holders = {}
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            holders.setdefault(line.strip(" \t\n\x0b\x0c\r").lower(), set()).add(i)
    for i, t in enumerate(texts):
        kept = [x for x in (t or "").split("\n") if not (len(k := x.strip(" \t\n\x0b\x0c\r").lower()) >= 40 and len(holders[k]) >= 5 and i != max(holders[k]))]
        assert out[i].text == "\n".join(kept) and out[i].n_dropped == len((t or "").split("\n")) - len(kept)


# all
def test_empty_tables_and_clashing_columns(spark, odd):
    for docs in (odd.limit(0), odd.selectExpr("*", "1 AS size", "2 AS u", "3 AS pii", "4 AS copies", "5 AS n_lines", "6 AS score", "'x' AS digest")):
        n = docs.count()
        assert pii.find_pii(docs).count() == n
        assert mixing.mix(docs).count() == n
        assert setsketch.near_duplicates(docs).count() == n
        assert line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs)).count() == n
        assert packing.pack(docs, tokenizer_path=TOKENIZER).count() >= n
        assert quality.score(docs, quality.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS label"))).count() == n
        path = fresh_path(spark, "codes")
        token_codes.write_token_codes(docs, path, tokenizer_path=TOKENIZER)
        assert token_codes.read_documents(token_codes.read_token_codes(spark, path)).count() == n
        path = fresh_path(spark, "docs")
        docs.write.parquet(path)
        assert exact_dedup.exact_duplicates(spark, path).count() == n
    assert sphere_filters.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    pages, path = spark.createDataFrame([], "page_id long, url string, html string"), fresh_path(spark, "warc")
    warc.write_warc(pages, path)
    assert warc.read_warc(spark, path).count() == 0


def test_lines_of_rows_without_an_id(spark):
    def kept(ids):
        docs = spark.createDataFrame([(i, "a line that is certainly longer than forty points") for i in ids], "doc_id long, text string")
        out = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs)).collect()
        return sorted((-1 if r.doc_id is None else r.doc_id, r.n_dropped) for r in out)

    assert kept([0, 1, 2, 3, None, None]) == [(-1, 0), (-1, 0), (0, 0), (1, 0), (2, 0), (3, 0)]
    assert kept([None] * 6) == [(-1, 0)] * 6
    assert kept([0, 1, 2, 3, 4, None]) == [(-1, 0), (0, 1), (1, 1), (2, 1), (3, 1), (4, 0)]
