import json
import random
import re
import time

import pytest

from hubbub.operators import lexicon, termscan

WATCH = lexicon.load_lexicon("watch_2")
ROWS = "post_id long, text string"


def label(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), ROWS)
    return list(lexicon.label_with(rows, WATCH).orderBy("post_id").collect())


def test_guards_short_codes_and_context(spark):
    texts = [
        "Phishing letters in the name of Halifax Bank", "Phishing letters seen in Halifax, signed Halifax Bank", "Malware found on laptops at YYZ", "Malware found on laptops at yyz near Toronto",
        "Malware found on laptops at YYZ near Toronto", "A botnet slows the city  hall pages", "City hall opens a skating rink", "Hospital and public library hit by a wiper", "Moncton hospital hit by a wiper",
        "Password dump sold, Canadians worried", None, "", "haha!", "Typosquatting in Trois-Rivières and at Iqaluit",
    ]
    out = label(spark, texts)
    assert [r.is_relevant for r in out] == [False, True, False, True, True, True, False, False, True, True, False, False, False, True]
    assert out[0].guards == out[1].guards == "halifax bank" and out[0].home_hits == "" and out[1].home_hits == "place:halifax"
    assert out[2].uncorroborated == "YYZ" and out[3].home_hits == "place:toronto" and out[4].home_hits == "place:toronto,code:YYZ" and out[4].home_score == 1.5
    assert out[5].home_hits == "office:city hall" and out[6].home_hits == "" and out[7].uncorroborated == "hospital,public library" and out[8].home_hits == "place:moncton,sector:hospital"
    assert out[9].cyber_hits == "re:(?:iban|password)s? (?:dump|list)" and out[13].home_hits == "place:iqaluit,place:trois-rivières"
    assert out[7].topic == "extortion" and out[7].topic_hits == "wiper" and out[6].topic == out[11].topic == "other"
    assert [r.low_reason for r in out[9:13]] == [None, "short", "short", "reaction"]
    assert out[4].confidence == 0.45 and out[2].confidence is None and {r.lexicon_versions for r in out} == {"cyber:words_3,home:places_2,topics:five_1"}


def test_case_matters_only_where_a_list_says_so(spark):
    lists = {"exact": termscan.Terms(("ARC", "Arc"), exact=True), "any": termscan.Terms(("arc", "arc lamp"))}
    rows = spark.createDataFrame([(0, "ARC"), (1, "arc"), (2, "an Arc  lamp"), (3, "ARCH arcs"), (4, "(ARC)/arc_")], ROWS)
    got = {r.post_id: (r.exact, r["any"]) for r in termscan.scan(rows, lists).collect()}
    assert got == {0: (["ARC"], ["arc"]), 1: ([], ["arc"]), 2: (["Arc"], ["arc", "arc lamp"]), 3: ([], []), 4: (["ARC"], ["arc"])}


def test_a_scan_equals_one_pattern_a_term():
    rng = random.Random(1)
    parts = ["ab", "AB", "c+", "d e", "é", "_", "-", " ", "  ", ".", "x1", "İ", "ß"]
    make = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(1, n)))
    terms = tuple(sorted({" ".join(make(3).split()).lower() for _ in range(60)} - {""})) + ("re:a.c", "re:^ab", "re:(?:d|e)+")
    for exact in (False, True):
        scanner = termscan.Scanner({"t": termscan.Terms(terms, exact=exact)})
        for _ in range(500):
            text = " ".join(make(12).split())
            want = [t for t in terms if re.search(termscan.compile_term(t, exact), text)]
            assert scanner.found(text, {"t"})["t"] == want or "İ" in text or "ß" in text, text


def test_a_thousand_terms_cost_about_as_much_as_fifty():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(4, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(1500)]

    def seconds(n):
        scanner, took = termscan.Scanner({"t": termscan.Terms(tuple(f"zz {w}" for w in dict.fromkeys(words[:n])))}), []
        for _ in range(3):
            began = time.perf_counter()
            for text in texts:
                scanner.found(text, {"t"})
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(1000) < 2 * seconds(50) + 0.02


def test_yield_of_terms(spark):
    posts = spark.createDataFrame([(1, "worm and trojan"), (2, "a WORM"), (3, "trojan trojan"), (4, None)], ROWS)
    hits = lexicon.term_hits(posts, ["worm", "trojan", "wiper"])
    got = {tuple(r) for r in lexicon.term_yield(hits, spark.createDataFrame([(1,), (2,), (2,)], "post_id long")).collect()}
    assert got == {("worm", 2, 2, 1, 1), ("trojan", 2, 1, 1, 0)}


GOOD = {"version": "x", "versions": {"cyber": "1", "home": "1", "topics": "1"}, "cyber": ["a"], "groups": {"x": {"weight": 1, "terms": ["a"]}}, "topics": [["t", ["a"]]]}


@pytest.mark.parametrize("change", [
    {"cyber": []}, {"cyber": ["a", "A"]}, {"cyber": ["re:(a"]}, {"cyber": ["re:"]}, {"versions": {"cyber": "1"}}, {"groups": {"x": {"weight": 0, "terms": ["a"]}}}, {"topics": [["other", ["a"]]]},
    {"topics": [["t", ["a"]], ["t", ["b"]]]}, {"groups": {"x": {"weight": 1, "terms": ["a"], "requires_corroboration": True}}}, {"guards": [" "]},
])
def test_a_faulty_file_is_refused(change):
    lexicon.parse_lexicon(json.dumps(GOOD))
    lexicon.parse_lexicon(json.dumps(GOOD | {"groups": {"x": {"weight": 1, "terms": ["a", "A"], "case_sensitive": True}}}))
    with pytest.raises(ValueError):
        lexicon.parse_lexicon(json.dumps(GOOD | change))


def test_an_unknown_version_is_refused():
    with pytest.raises(ValueError):
        lexicon.load_lexicon("none")
