"""Personal data: patterns propose spans, checksums confirm them, context words near a span move its score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import map_batches, values

#: The base kinds in their listed order, then the kinds this method adds.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "national"]
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9]{4})")
IBAN_GROUP = re.compile(r" ?[A-Z0-9]{4}")
IBAN_END = re.compile(r"(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
IBAN_NEXT = re.compile(r"(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Score of a confirmed span before its context, and what a context word adds; a span counts from ACCEPT on.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "national": 0.3}
BONUS, ACCEPT, NEAR = 0.2, 0.5, 48
CONTEXT = {
    "email": re.compile(r"mail|contact|write to|address", re.I),
    "ip": re.compile(r"\bip\b|server|host|login|address", re.I),
    "card": re.compile(r"card|visa|credit|payment|amex", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax", re.I),
    "iban": re.compile(r"iban|bank|account|konto|cuenta|compte", re.I),
    "national": re.compile(r"ssn|social|security|national|identity", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for sign in iban[4:] + iban[:4]:
        rest = int(f"{rest}{int(sign, 36)}") % 97
    return rest == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, in time linear in the text: every one is found from its @."""
    at, free, seen = text.find("@"), 0, 0
    while at >= 0:
        low = max(free, seen)
        start = low + len(text[low:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at) if start < at else None
        seen = at + 1
        if domain:
            yield start, domain.end()
            free = seen = domain.end()
        at = text.find("@", seen)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """From every head, the longest stretch of groups that passes mod-97, so words of capitals after a number don't hide it.

    A number has 15 to 34 signs, in 2 to 7 groups of four behind its head and a shorter last one.
    """
    free = 0
    for head in IBAN.finditer(text):
        if head.start() < free:
            continue
        at, ends = head.end(), []
        for number in range(1, 8):
            group = IBAN_GROUP.match(text, at)
            if not group:
                break
            at = group.end()
            if number >= 2:
                ends += [m.end() for m in (IBAN_NEXT.match(text, at), IBAN_END.match(text, at)) if m]
        for end in reversed(ends):
            plain = text[head.start():end].replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain):
                yield head.start(), end
                free = end
                break


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that their checks confirm, kind by kind."""
    for start, end in emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdecimal() for c in m.group()) <= 15:
                yield "phone", *m.span()
    for start, end in ibans(text):
        yield "iban", start, end
    for m in NATIONAL.finditer(text):
        yield "national", *m.span()


def personal_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by code points, by kind in listed order, then start."""
    out = []
    for kind, start, end in proposed(text):
        near = text[max(0, start - NEAR):start] + "\n" + text[end:end + NEAR]
        score = round(min(1.0, SCORES[kind] + (BONUS if CONTEXT[kind].search(near) else 0.0)), 2)
        if score >= ACCEPT:
            out.append((kind, start, end, score))
    return out


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end, score>> for every row of `docs` (doc_id, text).

    A null or empty text has no spans. Rows stand for themselves: repeated or null ids are kept. Texts are read whole,
    and every pattern takes time linear in them. Further columns are ignored; an empty table gives an empty one.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [personal_spans(t) if t else [] for t in values(batch, "text")]
            yield {"doc_id": values(batch, "doc_id"),
                   "spans": [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans] for spans in found]}

    return map_batches(docs.select("doc_id", "text"), scan,
                       "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>")


def digest(spans: DataFrame) -> DataFrame:
    """The counts and joined spans of find_personal_data()'s rows."""
    def joined(found: F.Column) -> F.Column:
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    return spans.select(
        "doc_id", *[F.expr(f"CAST(size(filter(spans, s -> s.kind = '{kind}')) AS long)").alias(f"n_{kind}") for kind in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"))
