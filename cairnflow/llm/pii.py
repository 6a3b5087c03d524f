"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (``email``, ``ip``, ``card``, ``phone``) follow fixed patterns and checks. The method adds
``iban`` (ISO 13616, confirmed by mod-97), ``ssn`` (three groups of digits, confirmed by its excluded
ranges and a context word) and ``secret`` (a long opaque value assigned to a telling name). Every span has
a score: what its kind's checks are worth, raised by a telling word within ``CONTEXT`` characters before it
and lowered by a word that marks digits as something else.

Defined results: a null or empty text has no span; a text of any length is scanned once per kind, in time
linear in its length; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import split_batch

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "secret")
KINDS = BASE_KINDS + ADDED_KINDS

#: Characters before a span in which context words count.
CONTEXT = 48

LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Possessive and anchored after a digit run, which finds the same matches as the plain pattern in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
SECRET = re.compile(r"(?i)\b(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)\b\s{0,4}[=:]\s{0,4}[\"']?([A-Za-z0-9+/_=-]{16,})")
DIGITS = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")

SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "secret": 0.8}
TELLING = {
    "email": re.compile(r"(?i)\b(?:mail|email|contact|write to)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|credit|debit|payment)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|call|tel|mobile|fax)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security)\b"),
    "secret": re.compile(r"(?i)\b(?:login|credentials?|auth)\b"),
}
MISLEADING = re.compile(r"(?i)\b(?:version|isbn|order|invoice|example|serial|ticket)\b")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """The mod-10 check of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 mod-97 over the account number with its head moved to the end."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(LOCAL_CHARS))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose checks hold, kind by kind in the order of KINDS and from left to right."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    if not DIGITS.search(text):
        yield from (("secret", m.start(1), m.end(1)) for m in SECRET.finditer(text))
        return
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        digits = NOT_DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain):
            yield "iban", m.start(), m.end()
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "ssn", m.start(), m.end()
    yield from (("secret", m.start(1), m.end(1)) for m in SECRET.finditer(text))


def find(text: str | None) -> list[Span]:
    """Every span of a text, base spans always, added ones where the score with context reaches 0.5."""
    if not text:
        return []
    spans = []
    for kind, a, b in _proposals(text):
        before = text[max(0, a - CONTEXT) : a]
        score = SCORES[kind] + 0.2 * bool(TELLING[kind].search(before)) - 0.2 * bool(MISLEADING.search(before))
        score = round(min(1.0, max(0.0, score)), 2)
        if kind in BASE_KINDS or score >= 0.5:
            spans.append(Span(kind, a, b, score))
    return spans


def mask(text: str | None, least: float = 0.5) -> str | None:
    """The text with each confirmed span replaced by its kind in brackets: base spans always, whatever stands before them, added ones of at least this score;
    overlapping spans become one, named by the first."""
    if not text:
        return text
    out, at = [], 0
    held = sorted((s for s in find(text) if s.kind in BASE_KINDS or s.score >= least), key=lambda s: (s.start, -s.end))
    i = 0
    while i < len(held):
        kind, start, end = held[i].kind, held[i].start, held[i].end
        while i + 1 < len(held) and held[i + 1].start < end:
            i += 1
            end = max(end, held[i].end)
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
        i += 1
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, counts by base kind, a digest of the base spans, all spans, their scores and their number."""

    def run(batches):
        for big in batches:
            for batch in split_batch(big):
                out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores", "n_spans")}
                for text in batch.column(1).to_pylist():
                    spans = find(text)
                    said = [f"{s.kind}:{s.start}:{s.end}" for s in spans]
                    base = [x for x, s in zip(said, spans) if s.kind in BASE_KINDS]
                    for kind in BASE_KINDS:
                        out[f"n_{kind}"].append(sum(s.kind == kind for s in spans))
                    out["base_sha256"].append(hashlib.sha256(",".join(base).encode()).hexdigest())
                    out["spans"].append(",".join(said))
                    out["scores"].append(",".join(f"{s.score:.2f}" for s in spans))
                    out["n_spans"].append(len(spans))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items())], ["doc_id", *out])

    return docs.selectExpr(f"cast(`{id_column}` as long) doc_id", f"cast(`{text_column}` as string) text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string, n_spans long"
    )


def masked(docs: DataFrame, text_column: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with its text column masked; every other column stays as it is, null texts stay null."""

    def run(batches):
        for big in batches:
            for batch in split_batch(big):
                at = batch.schema.get_field_index(text_column)
                yield batch.set_column(at, batch.schema.field(at), pa.array([mask(x, least) for x in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
