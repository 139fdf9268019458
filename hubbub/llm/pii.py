"""Personal data in whole texts.

Regular expressions propose spans. A validator confirms them: parts of at most 255 for addresses, Luhn for
cards, mod-97 for IBANs, digit counts for phones. Words near a span then raise or lower its score. Base kinds
(email, ip, card, phone) keep every confirmed span, whatever its score; of the kinds in ADDED a span
stays only if its score reaches min_score, so bare numbers count only beside a word that names them. Scores are
returned with the spans, so that a caller may set a limit of their own.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Rows are treated one by one, so
repeated rows, ties and hot sources change nothing; every search is linear in the length of the text.
An empty table gives no rows. Other columns pass through, but for one of the name `into`, which is replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from hubbub.llm.common import col, plain_names, whole_text

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "id_number")
SPANS = "array<struct<kind: string, start: int, end: int, score: double>>"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+").match
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})").finditer
_IBAN_END = re.compile(r"(?![A-Za-z0-9])").match
_ID = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])").finditer

# How long an account number is in each country.
_IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: Confidence that form and checksum give alone, and the words that change it.
_FORM = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "id_number": 0.3}
_NEAR = {
    "email": ("email", "mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "id_number": ("ssn", "social", "security", "insurance", "identity"),
}
_AGAINST = ("example", "sample", "version", "invoice", "order", "isbn", "serial")
_WORDS = re.compile(r"[a-z]{2,}").findall


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return len(code) > 4 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _iban_end(text: str, start: int) -> int | None:
    """Where the account number that starts there ends: as many characters as its country has, single spaces between."""
    left, at = _IBAN_LENGTH.get(text[start : start + 2], 0), start
    if not left:
        return None
    while left:
        if at > start and text[at : at + 1] == " ":
            at += 1
        c = text[at : at + 1]
        if not ("A" <= c <= "Z" or "0" <= c <= "9"):
            return None
        at, left = at + 1, left - 1
    return at if _IBAN_END(text, at) else None


def _emails(text: str):
    """Leftmost, non-overlapping: before each @ the whole run of local characters, after it a dotted name."""
    low, at = 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        start = low + len(before.rstrip(_LOCAL))
        found = _DOMAIN(text, at + 1) if start < at else None
        low = found.end() if found else at + 1
        if found:
            yield start, low
        at = text.find("@", low)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def _proposed(text: str):
    """(kind, start, end) of the confirmed spans."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    for m in _IP(text):
        if all(map(_small, m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE(text):
            if 10 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN(text):
        end = _iban_end(text, m.start())
        if end and mod97(text[m.start() : end].replace(" ", "")):
            yield "iban", m.start(), end
    for m in _ID(text):
        yield "id_number", m.start(), m.end()


def find_spans(text: str, window: int = 40, min_score: float = 0.5) -> list[tuple[str, int, int, float]]:
    """Spans by start, then kind as listed."""
    out = []
    for kind, start, end in _proposed(text):
        near = set(_WORDS(f"{text[max(0, start - window) : start]} {text[end : end + window]}".lower()))
        score = _FORM[kind] + 0.3 * any(w in near for w in _NEAR[kind]) - 0.2 * any(w in near for w in _AGAINST)
        if kind in BASE or score >= min_score:
            out.append((kind, start, end, round(min(1.0, max(0.0, score)), 2)))
    order = {k: i for i, k in enumerate(BASE + ADDED)}
    return sorted(out, key=lambda s: (s[1], order[s[0]], s[2]))


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, *, text: str = "text", into: str = "pii", window: int = 40, min_score: float = 0.5) -> DataFrame:
    """docs without the text column and with the array column `into` of kind, start, end and score."""
    columns, schema, names = plain_names(docs, (text, into))

    def spans(batches):
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(t, window, min_score)] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _SPAN_TYPE)], [*schema.names[:-1], "spans"])

    schema = StructType([*schema, StructField("spans", StructType.fromDDL(f"x {SPANS}")[0].dataType)])
    return docs.select(*columns, whole_text(col(text)).alias("text")).mapInArrow(spans, schema).toDF(*names, into)


def span_list(spans) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
