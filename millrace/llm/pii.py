"""Personal data: regular expressions propose spans, checksums confirm them, context scores them.

Base kinds (email, ip, card, phone) are decided by pattern and check alone. Further kinds (iban,
ssn, secret) need a checksum or a high score from words near the span. Spans are (kind, start,
end) in code points, end exclusive.

Defined cases: null and empty texts have no spans; spans of different kinds may overlap; repeated
rows are treated alike; only the id and the text are read (``redact`` keeps all columns).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, attach, read

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]

# The base patterns.
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Further proposals.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}))")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")

#: Words that raise a kind's score when they stand within WINDOW code points before a span, or less
#: so after it.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "credit", "payment", "account"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "key", "password", "passwd", "api", "auth", "bearer"),
}
WINDOW = 32
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.85, "phone": 0.8, "iban": 0.9, "ssn": 0.45, "secret": 0.3}
BOOST, BOOST_AFTER = 0.3, 0.1
CONTEXT_RE = {k: re.compile(r"(?<![a-z])(?:" + "|".join(v) + r")(?![a-z])", re.IGNORECASE) for k, v in CONTEXT.items()}


@dataclass(frozen=True)
class Span:
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


def mod97(text: str) -> bool:
    """The mod-97 check of account numbers: the first four characters go last, letters become
    10..35, and the number's remainder is 1."""
    moved = text[4:] + text[:4]
    remainder = 0
    for c in moved:
        remainder = (remainder * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return remainder == 1


def emails(text: str) -> Iterable[tuple[int, int]]:
    """Leftmost non-overlapping addresses, from each ``@`` outward; linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and EMAIL_LOCAL.match(text[start - 1]):
            start -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind and then by start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


def ibans(text: str) -> Iterable[tuple[int, int]]:
    """Account numbers: the longest that passes the check of those that end where a group does."""
    done = 0
    for m in IBAN.finditer(text):
        if m.start() < done:
            continue
        for end in range(m.end(1), m.end(), -1):
            if text[end - 1] == " " or (text[end : end + 1].isascii() and text[end : end + 1].isalnum()):
                continue
            plain = text[m.start() : end].replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain):
                yield m.start(), end
                done = end
                break


def secrets(text: str, threshold: float) -> Iterable[Span]:
    """Runs with letters and digits, from their start or else from after the first ``=`` from where
    they have the score (so that ``token=`` is a context)."""
    for m in SECRET.finditer(text):
        run = m.group()
        # The start must lie before the last letter, the last digit and the last twenty characters.
        last = min(max(i for i, c in enumerate(run) if c.isalpha()) if any(c.isalpha() for c in run) else -1, max(i for i, c in enumerate(run) if c.isdigit()), len(run) - 20)
        at = 0
        while at <= last:
            span = scored(text, "secret", m.start() + at, m.end())
            if span.score >= threshold:
                yield span
                break
            at = run.find("=", at) + 1
            if not at:
                break


def scored(text: str, kind: str, start: int, end: int) -> Span:
    before, after = (bool(CONTEXT_RE[kind].search(near)) for near in (text[max(0, start - WINDOW) : start], text[end : end + WINDOW]))
    return Span(kind, start, end, min(1.0, PRIOR[kind] + BOOST * before + BOOST_AFTER * after))


def spans(text: str | None, threshold: float = 0.5) -> list[Span]:
    """All spans of a whole text: base ones always, further ones from ``threshold`` up."""
    if not text:
        return []
    found = [scored(text, *s) for s in base_spans(text)]
    if not any(c in text for c in "0123456789"):
        return found
    more = [scored(text, "iban", *x) for x in ibans(text)]
    if "-" in text:
        more += [scored(text, "ssn", *m.span()) for m in SSN.finditer(text)]
    more += secrets(text, threshold)
    return found + [s for s in more if s.score >= threshold]


def joined(found: Iterable) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(found, key=lambda s: (KINDS.index(s.kind), s.start)))


def masked(text: str | None, threshold: float = 0.5) -> str | None:
    """The text with each span (overlapping ones merged) replaced by ``<KIND>``."""
    found = sorted(spans(text, threshold), key=lambda s: (s.start, -s.end))
    if not found:
        return text
    out, at = [], 0
    for s in found:
        if s.start < at:
            at = max(at, s.end)
            continue
        out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = s.end
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and an array of (kind, start, end, score), for every row."""

    def setup():
        return lambda ids, texts: (ids, [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in spans(t, threshold)] for t in texts])

    return arrow_map(docs, [F.col("doc_id").cast("bigint").alias("doc_id"), "text"], "doc_id long, spans array<struct<kind: string, start: int, end: int, score: double>>", setup)


def redact(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with personal data in ``text`` masked; other columns and all rows stay."""
    made = attach(docs, text, "__millrace_masked", "masked string", lambda: lambda texts: ([masked(t, threshold) for t in texts],))
    return made.withColumn(text, F.col("__millrace_masked.masked")).select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of personal data in every document."""

    def setup():
        def kernel(ids, texts):
            every = [spans(t) for t in texts]
            base = [[s for s in x if s.kind in BASE] for x in every]
            counts = [[sum(s.kind == k for s in x) for x in base] for k in BASE]
            return ids, *counts, [hashlib.sha256(joined(x).encode()).hexdigest() for x in base], [joined(x) for x in every], [max((s.score for s in x), default=0.0) for x in every]

        return kernel

    docs = read(spark, sf_dir, "documents")
    return arrow_map(docs, [F.col("doc_id").cast("bigint").alias("doc_id"), "text"], "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, top_score double", setup)
