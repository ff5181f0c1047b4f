import hashlib
import re

from fixtures import ROWS, small
from hypothesis import given, settings
from hypothesis import strategies as st
from sievetext.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    """Base spans straight from the patterns, leftmost and without retries."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                  "card": 13 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def _luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base(text):
    return [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@+-() 4A%_0259", max_size=60))
def test_base_spans_follow_the_patterns(text):
    assert base(text) == brute(text)


def test_base_spans_of_documents(spark):
    for r in small(spark).select("text").collect():
        assert base(r.text) == brute(r.text)


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    found = pii.find_spans("IBAN DE89 3704 0044 0532 0130 00 is ours")
    assert ("iban", 5, 32) in [s[:3] for s in found]


def test_context_moves_the_score():
    assert not [s for s in pii.find_spans("code 123-45-6789") if s[0] == "ssn"]
    assert [s[0] for s in pii.find_spans("SSN 123-45-6789")] == ["ssn"]
    plain, near = (pii.find_spans(t)[0][3] for t in ("x 10.0.0.1", "server 10.0.0.1"))
    assert near > plain


def test_redaction_merges_overlaps():
    assert pii.redact_text("ab 123 cd", [("x", 3, 6, 1.0), ("y", 4, 8, 1.0)]) == "ab <X>d"
    assert pii.redact_text(None, []) is None


def test_query_digests(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    got = {r.doc_id: r for r in pii.pii_digest(docs).collect()}
    for i, text, *_ in ROWS:
        spans = brute(text)
        assert got[i].base_sha256 == hashlib.sha256(
            ",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in spans) for k in pii.BASE_KINDS]
    assert got[7].n_card == got[7].n_ip == got[7].n_phone == got[7].n_email == 1


def test_redacted_documents(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert "<CARD>" in got[7].text and "4111" not in got[7].text and got[7].n_chars == len(got[7].text)
    assert got[1].text == ROWS[0][1] and got[3].text is None and got[1].score == 0.5
