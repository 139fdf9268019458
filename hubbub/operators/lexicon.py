"""Labels by a versioned lexicon file: terms, guards, home groups with weights and conditions, ordered topics."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from importlib import resources

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubbub.operators.content import effective_tokens
from hubbub.operators.termscan import PATTERN, Terms, compile_term, scan


@dataclass(frozen=True)
class Group:
    """requires_cyber: counts only in a text with a cyber term. requires_corroboration: only beside a hit of a group without
    this condition. case_sensitive: short names that are other words in lower case."""

    terms: list[str]
    weight: float
    requires_cyber: bool = False
    requires_corroboration: bool = False
    case_sensitive: bool = False


@dataclass(frozen=True)
class Lexicon:
    version: str
    versions: dict[str, str]
    cyber: list[str]
    groups: dict[str, Group]
    topics: list[tuple[str, list[str]]]
    guards: list[str] = field(default_factory=list)
    reactions: str = r"^(lol|ok|wow|yes|no|thanks)[.!]*$"
    min_tokens: int = 4


def parse_lexicon(text: str) -> Lexicon:
    """Checked: a version for each part, no empty or repeated terms, patterns that compile, weights above 0, topics named
    once and not `other`, some group that needs no corroboration."""
    raw = json.loads(text)
    groups = {name: Group(**g) for name, g in raw["groups"].items()}
    topics = [(name, terms) for name, terms in raw["topics"]]
    more = {k: raw[k] for k in ("guards", "reactions", "min_tokens") if k in raw}
    lexicon = Lexicon(raw["version"], raw["versions"], raw["cyber"], groups, topics, **more)
    if set(lexicon.versions) != {"cyber", "home", "topics"}:
        raise ValueError("versions must name those of cyber, home and topics")
    lists = {"cyber": lexicon.cyber, "guards": lexicon.guards, **{f"group {k}": g.terms for k, g in groups.items()}, **{f"topic {k}": t for k, t in topics}}
    exact = {f"group {k}" for k, g in groups.items() if g.case_sensitive}
    for name, terms in lists.items():
        if name != "guards" and not terms or any(not isinstance(t, str) or not t.strip() or t == PATTERN for t in terms):
            raise ValueError(f"{name}: no terms or an empty one")
        if len({t if name in exact else t.lower() for t in terms}) < len(terms):
            raise ValueError(f"{name}: a term is repeated")
        for t in terms:
            try:
                re.compile(compile_term(t))
            except re.error as error:
                raise ValueError(f"{name}: {t!r} is no pattern") from error
    if any(g.weight <= 0 for g in groups.values()):
        raise ValueError("a group without a positive weight")
    if len({k for k, _ in topics} | {"other"}) <= len(topics):
        raise ValueError("a topic is named twice or `other`")
    if all(g.requires_corroboration for g in groups.values()):
        raise ValueError("every group needs corroboration, so none can give it")
    return lexicon


def load_lexicon(version: str) -> Lexicon:
    path = resources.files("hubbub.lexicons") / f"{version}.json"
    if not path.is_file():
        raise ValueError(f"unknown lexicon version {version!r}")
    lexicon = parse_lexicon(path.read_text())
    if lexicon.version != version:
        raise ValueError(f"{version}.json says that it is {lexicon.version!r}")
    return lexicon


def label_with(posts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """post_id, is_cyber, cyber_hits, home_hits (group:term), uncorroborated, guards, home_score, is_home, topic, topic_hits,
    low_reason, is_relevant, confidence (NULL unless relevant), label_version, lexicon_versions.

    All terms are found in one reading of each text; what a guard covers is taken out before home terms are looked for. A
    post with little information is flagged and stays. A null text has no hits."""
    lists = {"cyber": Terms(tuple(lexicon.cyber)), "guards": Terms(tuple(lexicon.guards))}
    lists |= {f"g_{n}": Terms(tuple(g.terms), exact=g.case_sensitive, guarded=True) for n, g in lexicon.groups.items()}
    lists |= {f"t_{n}": Terms(tuple(terms)) for n, terms in lexicon.topics}
    rows = scan(posts, lists, "guards")
    none, has = F.array().cast("array<string>"), F.size("cyber") > 0
    counted = {n: F.when(has, F.col(f"g_{n}")).otherwise(none) if g.requires_cyber else F.col(f"g_{n}") for n, g in lexicon.groups.items()}
    strong = F.lit(False)
    for name, g in lexicon.groups.items():
        strong = strong if g.requires_corroboration else strong | (F.size(counted[name]) > 0)
    weak = lambda g: g.requires_corroboration
    kept = {n: F.when(strong, counted[n]).otherwise(none) if weak(g) else counted[n] for n, g in lexicon.groups.items()}
    score = sum((F.size(kept[n]) * g.weight for n, g in lexicon.groups.items()), F.lit(0.0))
    tag = lambda name: lambda t: F.concat(F.lit(f"{name}:"), t)
    tagged = F.concat(*(F.transform(kept[n], tag(n)) for n in lexicon.groups))
    alone = [F.when(~strong, counted[n]).otherwise(none) for n, g in lexicon.groups.items() if weak(g)]
    topic, topic_hits = F.when(F.lit(False), ""), F.when(F.lit(False), none)
    for name, _ in lexicon.topics:
        there = F.size(f"t_{name}") > 0
        topic, topic_hits = topic.when(there, name), topic_hits.when(there, F.col(f"t_{name}"))
    text_of = lambda c: F.array_join(c, ",")
    home = F.size(tagged) > 0
    few = F.size(effective_tokens(F.col("text"))) < lexicon.min_tokens
    low = F.when(F.lower("text").rlike(lexicon.reactions), "reaction").when(few, "short")
    confidence = F.when(has & home, F.round(F.least(F.lit(1.0), 0.15 * F.size("cyber") + 0.2 * score), 6))
    versions = ",".join(f"{k}:{v}" for k, v in sorted(lexicon.versions.items()))
    return rows.select(
        "post_id", has.alias("is_cyber"), text_of("cyber").alias("cyber_hits"), text_of(tagged).alias("home_hits"), text_of(F.concat(*alone) if alone else none).alias("uncorroborated"),
        text_of("guards").alias("guards"), F.round(score, 6).alias("home_score"), home.alias("is_home"), topic.otherwise("other").alias("topic"), text_of(topic_hits.otherwise(none)).alias("topic_hits"),
        low.alias("low_reason"), (has & home).alias("is_relevant"), confidence.alias("confidence"), F.lit(lexicon.version).alias("label_version"), F.lit(versions).alias("lexicon_versions"),
    )


def term_hits(posts: DataFrame, terms: list[str]) -> DataFrame:
    """post_id, term for each term that a post holds."""
    return scan(posts, {"terms": Terms(tuple(terms))}).select("post_id", F.explode("terms").alias("term"))


def term_yield(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """term, posts, relevant, only and relevant_only: posts that a term matches, the relevant ones, and those of both that no
    other term matches. relevant: post_id."""
    flag = relevant.select("post_id").distinct().withColumn("yes", F.lit(True))
    alone = hits.groupBy("post_id").agg(F.count(F.lit(1)).alias("n"))
    rows = hits.join(alone, "post_id").join(flag, "post_id", "left")
    yes, only = F.col("yes").isNotNull(), F.col("n") == 1
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("posts"), F.count_if(yes).alias("relevant"), F.count_if(only).alias("only"), F.count_if(yes & only).alias("relevant_only"))
