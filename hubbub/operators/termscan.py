"""Many terms looked for in one reading of a text.

All terms of all lists are one automaton, so the cost follows the text and not the number of terms. A hit counts only at
the edges of words, and in its own case where its list asks for that. Terms that begin with `re:` are patterns; they are
tried one by one, so lists should hold few of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN = "re:"


@dataclass(frozen=True)
class Terms:
    """exact: upper and lower case differ. guarded: looked for in what guards leave of a text."""

    terms: tuple[str, ...]
    exact: bool = False
    guarded: bool = False


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def compile_term(term: str, exact: bool = False) -> str:
    """The term as a pattern: bounded at an edge that is a word character, blanks stand for any white space; a pattern that is
    anchored stays so, any other is bounded where it begins or ends with a word character or a bracket."""
    case = "" if exact else "(?i)"
    if not term.startswith(PATTERN):
        left, right = (r"\b" if _is_word(c) else "" for c in (term[0], term[-1]))
        return case + left + r"\s+".join(map(re.escape, term.split())) + right
    body = term[len(PATTERN) :]
    if body.startswith(("^", r"\b")):
        return case + body
    left = r"\b" if _is_word(body[0]) or body[0] in r"([\\" else ""
    right = r"\b" if not body.endswith(("$", r"\b")) and (_is_word(body[-1]) or body[-1] in ")]?*+") else ""
    return f"{case}{left}(?:{body}){right}"


def _lower(text: str) -> str:
    """In lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Scanner:
    """Finds terms of lists in texts whose blanks are single."""

    def __init__(self, lists: dict[str, Terms]):
        self.lists, words = lists, {}
        self.patterns = []
        for name, terms in lists.items():
            for at, term in enumerate(terms.terms):
                if term.startswith(PATTERN):
                    self.patterns.append((name, at, re.compile(compile_term(term, terms.exact))))
                else:
                    term = " ".join(term.split())
                    words.setdefault(_lower(term), []).append((name, at, term if terms.exact else None, _is_word(term[0]), _is_word(term[-1])))
        self.automaton = ahocorasick.Automaton()
        for word, entries in words.items():
            self.automaton.add_word(word, (len(word), entries))
        if words:
            self.automaton.make_automaton()
        self.empty = not words

    def spans(self, text: str, names: set[str]) -> Iterator[tuple[str, int, int, int]]:
        """(list, place in it, start, end) of the hits in these lists."""
        low = _lower(text)
        for last, (n, entries) in () if self.empty else self.automaton.iter(low):
            start, end = last - n + 1, last + 1
            for name, at, exact, left, right in entries:
                if name in names and (exact is None or text[start:end] == exact):
                    if not (left and start and _is_word(low[start - 1]) or right and end < len(low) and _is_word(low[end])):
                        yield name, at, start, end
        for name, at, pattern in self.patterns:
            if name in names:
                yield from ((name, at, m.start(), m.end()) for m in pattern.finditer(text))

    def found(self, text: str, names: set[str]) -> dict[str, list[str]]:
        hits = {name: set() for name in names}
        for name, at, _, _ in self.spans(text, names):
            hits[name].add(at)
        return {name: [self.lists[name].terms[at] for at in sorted(places)] for name, places in hits.items()}

    def without(self, text: str, names: set[str]) -> str:
        """The text with a blank for what the hits of these lists cover."""
        out, done = [], 0
        for start, end in sorted((s, e) for _, _, s, e in self.spans(text, names)):
            if end > done:
                out += [text[done : max(start, done)], " "]
                done = end
        return " ".join("".join([*out, text[done:]]).split())


def scan(posts: DataFrame, lists: dict[str, Terms], guards: str | None = None) -> DataFrame:
    """post_id, text (blanks single, none at the ends; null: empty) and for each list the terms that the text holds, in order.

    guards names the list whose hits are taken out before guarded lists are looked for."""
    names = list(lists)
    plain = {n for n in names if not lists[n].guarded}

    def find(batches):
        scanner = Scanner(lists)
        for batch in batches:
            columns = {n: [] for n in names}
            for text in batch["text"].to_pylist():
                hits = scanner.found(text, plain)
                probe = scanner.without(text, {guards}) if guards and hits[guards] else text
                hits |= scanner.found(probe, set(names) - plain)
                for n in names:
                    columns[n].append(hits[n])
            yield pa.RecordBatch.from_arrays([batch["post_id"], batch["text"], *(pa.array(columns[n], pa.list_(pa.string())) for n in names)], ["post_id", "text", *names])

    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    rows = posts.select(F.col("post_id").cast("long").alias("post_id"), text.alias("text"))
    return rows.mapInArrow(find, "post_id long, text string, " + ", ".join(f"`{n}` array<string>" for n in names))
