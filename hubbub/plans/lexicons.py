"""Labels by the lexicon files over the adapted posts."""

from __future__ import annotations

from hubbub.operators import lexicon
from hubbub.operators.termscan import PATTERN
from hubbub.plans.catalog import register

BASE, WATCH = lexicon.load_lexicon("base_1"), lexicon.load_lexicon("watch_2")


def _pattern(term: str, exact: bool) -> str:
    """A term's pattern in SQL: bounded where it begins or ends with a letter, digit or underscore."""
    word = lambda c: r"\b" if c.isascii() and (c.isalnum() or c == "_") else ""
    if term.startswith(PATTERN):
        body = rf"\b(?:{term[len(PATTERN) :]})\b"
    else:
        body = word(term[0]) + term.replace("-", r"\-").replace(" ", r"\s+") + word(term[-1])
    return ("" if exact else "(?i)") + body.replace("'", "''")


def _in(terms, text: str, exact: bool = False) -> str:
    """The terms that the text holds, each by a constant pattern."""
    quoted = lambda t: t.replace("'", "''")
    cases = ", ".join(f"CASE WHEN regexp_matches({text}, '{_pattern(t, exact)}') THEN '{quoted(t)}' END" for t in terms)
    return f"list_filter([{cases}], lambda w: w IS NOT NULL)"


def twin(lex: lexicon.Lexicon) -> str:
    """lx: the labels of lex, term by term."""
    guarded = "x"
    for g in lex.guards:
        guarded = rf"regexp_replace({guarded}, '(?i)\b{g.replace(' ', chr(92) + 's+')}\b', ' ', 'g')"
    groups = ", ".join(f"{_in(g.terms, 'probe', g.case_sensitive)} AS g_{n}" for n, g in lex.groups.items())
    counted = {n: f"CASE WHEN len(cyber) > 0 THEN g_{n} ELSE [] END" if g.requires_cyber else f"g_{n}" for n, g in lex.groups.items()}
    strong = " OR ".join(f"len({counted[n]}) > 0" for n, g in lex.groups.items() if not g.requires_corroboration)
    kept = {n: f"CASE WHEN strong THEN {counted[n]} ELSE [] END" if g.requires_corroboration else counted[n] for n, g in lex.groups.items()}
    tagged = " || ".join(f"list_transform({k}, lambda w: '{n}:' || w)" for n, k in kept.items())
    score = " + ".join(f"len({kept[n]}) * {g.weight}::DOUBLE" for n, g in lex.groups.items())
    alone = " || ".join(f"CASE WHEN strong THEN [] ELSE {counted[n]} END" for n, g in lex.groups.items() if g.requires_corroboration) or "[]"
    topic = " ".join(f"WHEN len({_in(terms, 'x')}) > 0 THEN '{n}'" for n, terms in lex.topics)
    topic_hits = " ".join(f"WHEN len({_in(terms, 'x')}) > 0 THEN {_in(terms, 'x')}" for n, terms in lex.topics)
    tokens = r"""len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(x, 'https?://[^\s<>"'']+', ' ', 'g'), '@\w+', ' ', 'g'), '[^A-Za-z0-9]+'), lambda w: w <> ''))"""
    versions = ",".join(f"{k}:{v}" for k, v in sorted(lex.versions.items()))
    return rf"""a AS (SELECT post_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM posts),
      b AS (SELECT *, {guarded} AS probe, {_in(lex.cyber, 'x')} AS cyber, {_in(lex.guards, 'x')} AS guards FROM a),
      c AS (SELECT *, {groups} FROM b), d AS (SELECT *, {strong} AS strong FROM c), e AS (SELECT *, {score} AS score, {tagged} AS tagged FROM d),
      lx AS (SELECT post_id, len(cyber) > 0 AS is_cyber, array_to_string(cyber, ',') AS cyber_hits, array_to_string(tagged, ',') AS home_hits, array_to_string({alone}, ',') AS uncorroborated,
        array_to_string(guards, ',') AS guards, round(score, 6) AS home_score, len(tagged) > 0 AS is_home, CASE {topic} ELSE 'other' END AS topic,
        array_to_string(CASE {topic_hits} ELSE [] END, ',') AS topic_hits, CASE WHEN regexp_matches(lower(x), '{lex.reactions}') THEN 'reaction' WHEN {tokens} < {lex.min_tokens} THEN 'short' END AS low_reason,
        len(cyber) > 0 AND len(tagged) > 0 AS is_relevant, CASE WHEN len(cyber) > 0 AND len(tagged) > 0 THEN round(least(1.0, 0.15 * len(cyber) + 0.2 * score), 6)::DOUBLE END AS confidence,
        '{lex.version}' AS label_version, '{versions}' AS lexicon_versions FROM e)"""


def labelled(t, lex: lexicon.Lexicon = WATCH):
    return lexicon.label_with(t.posts, lex)


_LX, _BX = twin(WATCH), twin(BASE)


def by_post(name: str, columns: str, lex: lexicon.Lexicon = WATCH) -> None:
    register(name, lambda t: labelled(t, lex).select(*columns.split(", ")), f"WITH {_LX if lex is WATCH else _BX} SELECT {columns} FROM lx")


register("label_lexicon", labelled, f"WITH {_LX} SELECT * FROM lx")
register("label_rules", lambda t: labelled(t, BASE), f"WITH {_BX} SELECT * FROM lx")
by_post("cyber_hits", "post_id, cyber_hits, is_cyber")
by_post("geo_hits", "post_id, home_hits, uncorroborated, guards, home_score, is_home")
by_post("geo_hits_by_post", "post_id, home_hits, uncorroborated, guards, home_score")
by_post("assign_topic", "post_id, topic, topic_hits", BASE)
by_post("topic_by_post", "post_id, topic, topic_hits")
by_post("low_information", "post_id, low_reason")

_TH = f"""th AS (SELECT post_id, unnest({_in(WATCH.cyber, "trim(regexp_replace(text, '\\s+', ' ', 'g'))")}) AS term FROM posts),
      n AS (SELECT post_id, count(*) = 1 AS alone FROM th GROUP BY 1), r AS (SELECT DISTINCT post_id, true AS yes FROM relevant),
      ty AS (SELECT term, count(*) AS posts, count(*) FILTER (yes) AS relevant, count(*) FILTER (alone) AS "only", count(*) FILTER (yes AND alone) AS relevant_only
             FROM th JOIN n USING (post_id) LEFT JOIN r USING (post_id) GROUP BY 1)"""


def yields(t):
    return lexicon.term_yield(lexicon.term_hits(t.posts, WATCH.cyber), t.relevant)


register("term_yield", lambda t: yields(t).select("term", "posts", "relevant"), f"WITH {_TH} SELECT term, posts, relevant FROM ty")
register("term_exclusive", yields, f"WITH {_TH} SELECT * FROM ty")
