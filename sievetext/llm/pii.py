"""Personal data: regular expressions propose spans, checksums confirm them,
context words move the score.

Every proposal is linear in the text: the mail pattern is anchored at its
``@``, digit patterns walk maximal digit chains, so a very long run of one
character class costs one pass.  Offsets are code points, end exclusive.

Defined cases: null and empty texts have no spans; repeated rows each keep
their own spans; other columns pass through, except that an input column with
the name of the output column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, give_back, joined_spans, small_batches, without

# The kinds in output order; the first four are the base kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

# Score of a confirmed proposal, and what a context word adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT_BONUS = 0.3

# Context words by kind (lower case).
CONTEXT = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social security", "tax id"),
}
CONTEXT_CHARS = 48

# IBAN length by country code.
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28,
    "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    """Luhn check of a string of digits."""
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 mod 97-10 check of an IBAN without blanks."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(ch, 36)) for ch in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        if len(parts) < 4:
            continue
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_ANY_DIGIT.findall(m.group())) <= 15:
                yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        want = IBAN_LENGTH.get(m.group()[:2])
        if not want:
            continue
        got, at = list(m.group()), m.end()
        while len(got) < want and at < len(text):
            ch = text[at]
            if ch.isascii() and (ch.isdigit() or ch.isupper()):
                got.append(ch)
            elif ch != " " or text[at - 1] == " ":
                break
            at += 1
        ended = at == len(text) or not (text[at].isascii() and text[at].isalnum())
        if len(got) == want and ended and mod97("".join(got)):
            yield m.start(), at


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        if m.group()[:3] not in ("000", "666") and m.group()[0] != "9" \
                and m.group()[4:6] != "00" and m.group()[7:] != "0000":
            yield m.span()


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones,
            "iban": _ibans, "ssn": _ssns}


def _context_score(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - CONTEXT_CHARS):start]} {text[end:end + CONTEXT_CHARS // 2]}".lower()
    bonus = CONTEXT_BONUS if any(w in near for w in CONTEXT[kind]) else 0.0
    return round(min(1.0, SCORES[kind] + bonus), 3)


def find_spans(text: str | None, threshold: float = 0.5) -> list[tuple[str, int, int, float]]:
    """All ``(kind, start, end, score)`` of a text with a score of at least
    ``threshold``, by kind in the order of :data:`KINDS`, then start."""
    if not text:
        return []
    out = []
    digits = _ANY_DIGIT.search(text) is not None
    for kind in KINDS:
        if kind != "email" and not digits:
            break
        for start, end in _FINDERS[kind](text):
            score = _context_score(text, kind, start, end)
            if score >= threshold:
                out.append((kind, start, end, score))
    return out


def redact_text(text: str | None, spans) -> str | None:
    """``text`` with each span replaced by ``<KIND>``; spans that overlap
    become one, named after the first."""
    if not text or not spans:
        return text
    out, at, open_kind = [], 0, None
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at or open_kind is None:
            out += [text[at:start], f"<{kind.upper()}>"]
            open_kind = kind
        at = max(at, end)
    return "".join(out) + text[at:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                   ("score", pa.float64())])
_SPAN_DDL = "array<struct<kind:string,start:int,end:int,score:double>>"


def _span_udf(threshold: float):
    @F.arrow_udf(_SPAN_DDL)
    def spans(texts: pa.Array) -> pa.Array:
        found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True))
                  for s in find_spans(t.as_py(), threshold)] for t in texts]
        return pa.array(found, type=pa.list_(_SPAN))

    return spans


def with_pii(docs: DataFrame, text_col: str = "text", output: str = "pii",
             threshold: float = 0.5) -> DataFrame:
    """``docs`` plus the array of spans ``(kind, start, end, score)``."""
    return without(small_batches(docs), output).withColumn(output, _span_udf(threshold)(F.col(text_col).cast("string")))


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.5,
           length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind; the length column, if the
    table has it, follows the new text.  Rows, columns and their order stay."""

    @F.arrow_udf("string")
    def hidden(texts: pa.Array) -> pa.Array:
        plain = (t.as_py() for t in texts)
        give_back()
        return pa.array([redact_text(t, find_spans(t, threshold)) for t in plain], pa.string())

    new = free_name(docs, "redacted")
    out = small_batches(docs).withColumn(new, hidden(F.col(text_col).cast("string")))
    length = F.length(F.col(new)).cast("long")
    return out.select(*[
        F.col(new).alias(c) if c == text_col
        else F.when(F.col(c).isNull() | F.col(new).isNull(), F.col(c)).otherwise(length).alias(c)
        if c == length_col else F.col(c) for c in docs.columns])


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests per document: the rows of the registered query."""
    found = with_pii(docs.select("doc_id", "text"), output="pii").select("doc_id", "pii")

    def kind_count(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[kind_count(k) for k in BASE_KINDS],
                        F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"),
                        joined_spans(F.col("pii")).alias("spans"),
                        F.array_max(F.transform("pii", lambda s: s["score"])).alias("top_score"))
