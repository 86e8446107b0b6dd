"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Keys and tokens have no checksum; their entropy, the name they are assigned to and the openings of known services take its place.

Each pattern is written so that a long run of its characters is passed over once: the scan stays linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from cytoloom.llm.texts import map_texts
from cytoloom.scratch import bound_batches

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
COLUMNS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Openings by which services mark their keys; such a token, or a private key's head, needs no other proof.
MARKED = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}")
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z]{2,10} ){0,3}PRIVATE KEY-----")
#: An opaque token, and what stands before one that is assigned to a name of a secret.
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")
ASSIGNED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|(?:api|access|auth|private)[_-]?key|bearer)[A-Za-z0-9_-]{0,20}[\"']?[ \t]{0,4}(?:[:=]|[ ])[ \t]{0,4}[\"']?\Z")
#: A token is opaque that mixes letters and digits and has so many bits a character.
LEAST_BITS = 3.0
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "payment", "credit"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security", "insurance"),
    "secret": ("token", "secret", "key", "password", "auth", "bearer", "credential", "credentials"),
}
AGAINST = ("version", "isbn", "order", "serial", "part")
#: Score of a span by kind before its context counts, and how much words within NEAR characters add or take.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "secret": 0.3}
NEAR, MORE, LESS = 40, 0.2, 0.3
#: Score of a secret that is marked as one or assigned to a name of one.
SURE = 0.9
#: Spans of the kinds outside BASE count from this score on; a base span counts at any score.
LEAST_SCORE = 0.5


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(text: str) -> bool:
    moved = text[4:] + text[:4]
    return 15 <= len(moved) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                yield start, end
        at = text.find("@", max(end, at + 1))


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", m.start(), m.end()
    if "-" in text:
        for m in SSN.finditer(text):
            yield "ssn", m.start(), m.end()


def bits(token: str) -> float:
    """Bits of entropy a character, by the token's own counts."""
    return sum(n / len(token) * log2(len(token) / n) for n in Counter(token).values())


def _secrets(text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, score before context) of private key heads and of opaque tokens."""
    if "-----BEGIN " in text:
        for m in PRIVATE_KEY.finditer(text):
            yield m.start(), m.end(), SURE
    for m in OPAQUE.finditer(text):
        token = m[0]
        if MARKED.match(token):
            yield m.start(), m.end(), SURE
        elif any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and bits(token) >= LEAST_BITS:
            sure = ASSIGNED.search(text[max(0, m.start() - NEAR) : m.start()])
            yield m.start(), m.end(), SURE if sure else SCORE["secret"]


def _score(text: str, kind: str, start: int, end: int, own: float) -> float:
    words = set(re.findall(r"[a-z]+", text[max(0, start - NEAR) : start].lower() + " " + text[end : end + NEAR].lower()))
    return min(1.0, max(0.0, own + MORE * any(w in words for w in CONTEXT[kind]) - LESS * any(w in words for w in AGAINST)))


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then as KINDS lists them; code points, end exclusive."""
    if not text:
        return []
    found = [("email", *span) for span in _emails(text)] + list(_numbers(text))
    scored = [(k, a, b, round(_score(text, k, a, b, SCORE[k]), 2)) for k, a, b in found]
    scored += [("secret", a, b, round(_score(text, "secret", a, b, own), 2)) for a, b, own in _secrets(text)]
    return sorted((x for x in scored if x[0] in BASE or x[3] >= LEAST_SCORE), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    spans = find_spans(text)
    if not spans:
        return text
    out, end = [], 0
    for kind, a, b, _ in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def report(text: str | None) -> tuple:
    """COLUMNS of one text."""
    spans = find_spans(text)
    base = [s for s in spans if s[0] in BASE]
    scores = ",".join(f"{s[3]:.2f}" for s in spans)
    return *(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans), scores


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts, digest, spans and their scores per document.  Null and empty texts have none; rows stay one to one with the input.

    Needs doc_id and text only; a null doc_id stays null.  ``scores`` has one number for each of ``spans``, in their order.
    """
    return map_texts(docs, lambda: lambda texts: [(i, *report(t)) for i, t in enumerate(texts)], COLUMNS)


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data in ``text`` replaced; every other column as it came, null texts null."""

    bound_batches(docs.sparkSession)

    def clean(text: pd.Series) -> pd.Series:
        return text.map(redact, na_action="ignore")

    return docs.withColumn("text", F.pandas_udf(clean, StringType())("text"))
