"""Personal data: regular expressions propose spans, checksums confirm them, words nearby move the score.

Kinds and their tests:

* email, ip (parts at most 255), card (14 to 19 digits, Luhn), phone (10 to 15 digits): base kinds. What the test
  passes is a span whatever its score; a match that fails it is dropped without a retry.
* iban (two letters, two check digits, 11 to 30 letters or digits, blanks between groups of four; mod 97 = 1;
  a match that fails is tried again without its last groups, as capital words may follow, then from its next group),
  ssn (ddd-dd-dddd, no part of zeros, area below 900 and not 666), secret (a value of 12 or more characters given to a
  name such as password or token): further kinds, kept when their score reaches KEEP.

The score starts at the kind's own value (higher where a checksum confirmed the span) and gains or loses with the
words within NEAR characters before or after the span. Spans are code points, end exclusive. Null texts count as
empty and give no spans. Repeated rows give repeated rows; nothing is shuffled. Every expression reads a text
once: the anchors (``@``, the start of a run of digits, ``+``) are where a match can begin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tributary.llm.common import documents_of, pieces, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
#: Own score of a confirmed span of each kind, the score from which a further kind is kept, and the reach of context.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.45, "secret": 0.7}
KEEP, NEAR = 0.5, 40
#: Words that speak for a kind, and words that speak against any.
FOR = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security", "insurance"),
    "secret": ("key", "secret", "login", "access"),
}
AGAINST = ("example", "version", "sample", "isbn", "order", "serial", "test")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
SECRET = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\x20\"']{0,2}[=:][\x20\"']{0,2}([A-Za-z0-9+/_-]{12,})")
SPAN = ArrayType(
    StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())])
)
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping matches of local@domain: a match can only begin at the run of local characters before an @."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and (text[start - 1].isalnum() and text[start - 1].isascii() or text[start - 1] in "._%+-"):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        else:
            last = at + 1
        at = text.find("@", last)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping accounts, each the longest run of groups that passes the checksum."""
    m = IBAN.search(text)
    while m:
        end, at = m.end(), m.start() + 1
        while end > m.start():
            code = text[m.start() : end].replace(" ", "")
            if 15 <= len(code) <= 34 and mod97(code):
                yield m.start(), end
                at = end
                break
            end = text.rfind(" ", m.start(), end)
        m = IBAN.search(text, at)


def proposals(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, number of the kind, end) of confirmed spans."""
    if "@" in text:
        yield from ((a, 0, b) for a, b in emails(text))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().translate({32: None, 45: None})
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), 2, m.end()
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                yield m.start(), 1, m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                yield m.start(), 3, m.end()
    yield from ((a, 4, b) for a, b in ibans(text))
    if "-" in text:
        for m in SSN.finditer(text):
            area, group, serial = m.groups()
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                yield m.start(), 5, m.end()
    if "=" in text or ":" in text:
        yield from ((m.start(1), 6, m.end(1)) for m in SECRET.finditer(text))


def score(text: str, start: int, kind: str, end: int) -> float:
    near = re.findall(r"[a-z]+", (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower())
    up = any(w.startswith(FOR[kind]) for w in near)
    down = any(w in AGAINST for w in near)
    return round(min(1.0, max(0.0, START[kind] + 0.3 * up - 0.3 * down)), 3)


def find(text: str) -> list[dict]:
    out = []
    for start, number, end in sorted(proposals(text)):
        kind = KINDS[number]
        value = score(text, start, kind, end)
        if kind in BASE or value >= KEEP:
            out.append({"kind": kind, "start": start, "end": end, "score": value})
    return out


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, found array<struct<kind, start, end, score>> ordered by start, then kind as listed."""
    source = documents_of(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([find(t) for t in texts_of(batch)], ARROW_SPAN)], ["doc_id", "found"]
            )

    return source.mapInArrow(run, StructType([StructField("doc_id", source.schema["doc_id"].dataType), StructField("found", SPAN)]))


def redact(text: str | None) -> str | None:
    """Each span's text replaced by its kind in brackets; spans that overlap become one, named after the first."""
    if not text:
        return text
    out, last = [], 0
    spans = find(text)
    i = 0
    while i < len(spans):
        start, end, kind = spans[i]["start"], spans[i]["end"], spans[i]["kind"]
        while i + 1 < len(spans) and spans[i + 1]["start"] < end:
            i += 1
            end = max(end, spans[i]["end"])
        out += [text[last:start], f"[{kind.upper()}]"]
        last, i = end, i + 1
    return "".join([*out, text[last:]])


def redacted(text: Column) -> Column:
    """The text without its personal data; null stays null."""
    return F.udf(redact, StringType(), useArrow=True)(text)
