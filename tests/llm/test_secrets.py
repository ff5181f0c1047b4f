import hashlib
import math
import random
import re
import string

import pytest
from fixtures import ROWS, documents, small
from pyspark.sql import functions as F
from sievetext.llm import secrets

PATTERNS = {
    "assign": re.compile("((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+"),
}


def brute(text):
    out = []
    for order, (kind, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(text or ""):
            if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= {"access": 20, "hex": 24}[kind]:
                out.append((m.start(), order, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def check(docs, texts):
    rows = secrets.secret_digest(docs).collect()
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r.doc_id
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("random")] == want
    return rows


def test_base_spans_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = check(docs, {r.doc_id: r.text for r in docs.collect()})
    assert sum(r.n_assign + r.n_hex for r in rows) > 0


def test_base_spans_of_awkward_rows(spark, awkward):
    check(spark.read.parquet(f"{awkward}/documents.parquet"), {i: t for i, t, *_ in ROWS})


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(3)
    bits = ["password", "Secret", "api_key", "TOKEN", "=", ": ", " ", "'", '"', "abc123", "x" * 7, "AKIA", "AKIA" + "Q" * 17,
            "deadbeef" * 3, "é", "\U0001f600", "\n", "K"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts.append("é token=abcdef " * 700)  # more matches than a block of prefix sums holds
    texts.append("token=" + "A" * 100_000)
    check(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), dict(enumerate(texts)))


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(5)
    made = {}
    words = ["internationalization", "counterrevolutionaries", "aaaaaaaaaaaaaaaaaaaaaaaa", "abcdefghijklmnopqrstuvwxyz",
             "pneumonoultramicroscopic", "the_quick_brown_fox_jumps_over", "ThisIsAVeryLongCamelCaseName",
             "012345678901234567890123", "Donaudampfschifffahrtsgesellschaft"]
    for i in range(120):
        kind = rng.choice([string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"])
        made[i] = ("".join(rng.choice(kind) for _ in range(rng.choice([24, 32, 40, 64]))), True)
    for i in range(120, 400):
        made[i] = (rng.choice(words), False)
    docs = documents(spark, [(i, f"see {t} here", "en", "s") for i, (t, _) in made.items()])
    got = {r.doc_id: r.n_random > 0 for r in secrets.secret_digest(docs).collect()}
    found = sum(got[i] for i, (_, real) in made.items() if real)
    wrong = [made[i][0] for i, (_, real) in made.items() if not real and got[i]]
    assert found >= 100 and not wrong


def test_no_python_in_the_plan(spark):
    out = secrets.with_secrets(small(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "text" in out.columns


def plain_battery(token):
    """The statistics of :func:`secrets.battery` in plain Python."""
    size = next(k for pattern, k in secrets.ALPHABETS if not pattern or re.fullmatch(f"(?:{pattern})", token))

    def runs_of(text):
        for pattern, to in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), ("[^aA0]+", "-")):
            text = re.sub(pattern, to, text)
        return len(text)

    n, x = len(token), [ord(c) for c in token]
    names = re.sub(secrets.NAME, "a", token)
    for pattern, to in (("[A-Z]+", "A"), ("[0-9]+", "0"), ("[^aA0]+", "-")):
        names = re.sub(pattern, to, names)
    same = sum(x.count(d) ** 2 for d in set(x))
    mean = sum(x) / n
    var = sum(v * v for v in x) - n * mean * mean
    lag = sum((u - mean) * (v - mean) for u, v in zip(x, x[1:]))
    chi = (size / n * same - n - (size - 1)) / math.sqrt(2 * (size - 1))
    serial = (lag / var + 1 / n) * math.sqrt(n) if var > 0 else 99.0
    change = {16: 0.469, 32: 0.305, 36: 0.401}.get(size, 0.62)
    runs = (runs_of(token) - 1 - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change))
    pairs, pt, ct = n * (n - 1) / 2, secrets.TEXT_PAIRS, secrets.TEXT_CHANGES
    few = (pairs * pt - (same - n) / 2) / math.sqrt(pairs * pt * (1 - pt))
    many = (len(names) - 1 - (n - 1) * ct) / math.sqrt((n - 1) * ct * (1 - ct))
    passed = abs(chi) <= 2 * secrets.RANDOM_Z and abs(runs) <= secrets.RANDOM_Z and abs(serial) <= secrets.RANDOM_Z
    z = (few + many) / math.sqrt(2)
    tail = math.exp(-z * z / 2) / 2.5066282746310002 / (0.661 * abs(z) + 0.339 * math.sqrt(z * z + 5.51))
    return n, chi, runs, serial, passed, tail if z >= 0 else 1 - tail


def plain_control(tests, rate=secrets.FALSE_DISCOVERY):
    """Accepted tokens by Benjamini-Hochberg on sorted p-values, per length class."""
    groups = {}
    for token, (n, *_, passed, p) in tests.items():
        place = sum(n >= e for e in secrets.LENGTH_ENDS)
        step = min(secrets.MAX_BIN, math.floor(-math.log10(max(p, 1e-60)) / secrets.BIN)) if passed else 0
        groups.setdefault(place, []).append((10.0 ** (-step * secrets.BIN), token))
    out = set()
    for rows in groups.values():
        rows.sort()
        good = [p for i, (p, _) in enumerate(rows, 1) if p <= rate * i / len(rows) and p < 1]
        out |= {t for p, t in rows if good and p <= good[-1]}
    return out


ENCODINGS = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567",
             "alphanumeric": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/",
             "lower": string.ascii_lowercase + string.digits}


def test_battery_and_control_equal_plain_ones(spark):
    rng = random.Random(11)
    tokens = {"".join(rng.choice(c) for _ in range(rng.choice([20, 28, 33, 40, 64, 90]))) for c in ENCODINGS.values() for _ in range(12)}
    tokens |= {"internationalization", "ThisIsAVeryLongCamelCaseName", "the_quick_brown_fox_jumps_over", "a" * 30,
               "aB" * 20, "0123456789" * 3, "==--==--==--==--==--==--", "some-file-name/with-parts/and-more_parts"}
    df = spark.createDataFrame([(t,) for t in tokens], "token string").select("token", secrets.battery(F.col("token")).alias("t"))
    want = {t: plain_battery(t) for t in tokens}
    for r in df.collect():
        n, chi, runs, serial, passed, p = want[r.token]
        assert r.t.n == n and r.t.random == passed
        assert [r.t.chi, r.t.runs, r.t.serial] == pytest.approx([chi, runs, serial], abs=1e-6)
        assert r.t.p == pytest.approx(p, rel=1e-6, abs=1e-12)
    docs = documents(spark, [(i, f"({t})", "en", "s") for i, t in enumerate(sorted(tokens))])
    got = {r.doc_id for r in secrets.secret_digest(docs).collect() if r.n_random}
    assert got == {i for i, t in enumerate(sorted(tokens)) if t in plain_control(want)}


def test_recall_by_encoding_and_length(spark):
    rng = random.Random(2)
    rows, kind = [], {}
    for name, letters in ENCODINGS.items():
        for n in (24, 32, 40, 64):
            for _ in range(60):
                kind[len(rows)] = (name, n)
                rows.append((len(rows), "key " + "".join(rng.choice(letters) for _ in range(n)), "en", "s"))
    got = {r.doc_id: r.n_random > 0 for r in secrets.secret_digest(documents(spark, rows)).collect()}
    found = {k: sum(got[i] for i, v in kind.items() if v == k) / 60 for k in set(kind.values())}
    assert {k: v for k, v in found.items() if v < 0.9} == {}
