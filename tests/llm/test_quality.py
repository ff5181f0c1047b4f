import re
from collections import Counter

import pytest
from fixtures import ROWS, documents, small
from sievetext.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    """Counts straight from their definitions."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [s for s in text.split("\n") if WORD.search(s)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


def failed(c):
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def check(rows, texts):
    for r in rows:
        want = brute(texts[r.doc_id])
        assert tuple(r[n] for n in quality.COUNTS) == want, r.doc_id
        assert r.base_failed == failed(want) and not (r.base_failed and r.kept)


def test_counts_of_documents(spark):
    docs = small(spark)
    check(quality.quality_digest(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_counts_of_awkward_rows(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    check(quality.quality_digest(docs).collect(), {i: t for i, t, *_ in ROWS})


def test_windows_that_overlap(spark):
    texts = ["a a a a", "a b c a b c", "a b c x a b c", "a b", "", "x\nx\n x\nx ", "p q r p q r p q r s",
             "a\x0bb\x0cc\ra\x1cb", "#|<> \n\n \n"]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    check(quality.quality_digest(docs).collect(), dict(enumerate(texts)))


def test_prior():
    a, b = quality.beta_prior(0, None, None, None, None)
    assert (a, b) == (1.0, 1.0)
    a, b = quality.beta_prior(1000, 100, 0.1, 0.0, 0.01)  # no spread between hosts: a strong prior
    assert a / (a + b) == pytest.approx(0.1) and a + b == 1000
    a, b = quality.beta_prior(1000, 500, 0.5, 0.2, 0.001)  # hosts differ: a weak one
    assert 1 <= a + b < 1000


GOOD = " ".join(f"word{i}" for i in range(60))
BAD = GOOD + " #" * 20  # 80 words, 20 symbols: severity 2.5


def _hosts(spark):
    rows, k = [], 0
    for host, n_good, n_bad in (("fine", 60, 1), ("awful", 2, 80), ("small", 0, 1), ("other", 40, 2)):
        for text, n in ((GOOD, n_good), (BAD, n_bad)):
            for _ in range(n):
                rows.append((k, f"{text} {k}", "en", host))
                k += 1
    return documents(spark, rows)


def test_host_verdicts(spark):
    got = quality.with_verdict(_hosts(spark)).collect()
    rate = {r.source: r.host_rate for r in got}
    assert rate["fine"] < rate["other"] < rate["small"] < 1 and rate["awful"] > 0.6
    assert rate["awful"] > rate["small"]  # one document is weak evidence
    kept = Counter((r.source, r.mild_failed) for r in got if r.kept)
    # Documents that break no rule stay, on any host; mild failures only on good hosts.
    assert kept[("awful", False)] == 2 and kept[("awful", True)] == 0
    assert kept[("fine", True)] == 1 and kept[("fine", False)] == 60


def plain_verdicts(docs):
    """``{id: kept}`` of ``(id, text, host)`` rows, straight from the rule."""
    counts, failures, broken = {}, Counter(), {}
    for i, text, host in docs:
        c = brute(text)
        n_lines = sum(1 for s in (text or "").split("\n") if WORD.search(s))
        mean = c[1] / max(c[0], 1)
        broken[i] = max(c[2] / max(0.1 * c[0], 1), c[3] / max(0.3 * n_lines, 1), mean / 15, 2 / max(mean, 1))
        counts[i] = c
        failures[host] += failed(c) or broken[i] > 1
    sizes = Counter(host for *_, host in docs)
    rates = [failures[h] / n for h, n in sizes.items()]
    mean = sum(rates) / len(rates)
    var = sum((r - mean) ** 2 for r in rates) / (len(rates) - 1) if len(rates) > 1 else None
    a, b = quality.beta_prior(len(docs), sum(failures.values()), mean, var, sum(1 / n for n in sizes.values()) / len(sizes))
    return {i: not failed(counts[i]) and broken[i] * (failures[h] + a) / (sizes[h] + a + b) <= 1 for i, _, h in docs}


def test_hosts_that_all_mix_good_and_bad(spark):
    rows, k = [], 0
    for host, bad in (("a", 4), ("b", 5), ("c", 4), ("d", 30)):
        for n in range(40):
            # From no more than the limit of symbols to far beyond it.
            rows.append((k, GOOD + (" #" + "#" * (n * 60) if n < bad else "") + f" {k}", "en", host))
            k += 1
    got = {r.doc_id: r for r in quality.with_verdict(documents(spark, rows)).collect()}
    assert {i: r.kept for i, r in got.items()} == plain_verdicts([(i, t, h) for i, t, _, h in rows])
    assert all(r.kept for r in got.values() if r.severity <= 1)
    lost = {h: [r.severity for r in got.values() if r.source == h and not r.kept] for h in "abcd"}
    held = {h: [r.severity for r in got.values() if r.source == h and r.kept and r.severity > 1] for h in "abcd"}
    for h in "abcd":  # each host loses its worst, the worst host most of the mild ones too
        assert lost[h] and min(lost[h]) > max(held[h], default=0)
    assert min(lost["d"]) < min(lost["a"])


def test_verdict_decides_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality.quality_digest(docs).collect()
    assert any(r.kept == r.base_failed for r in got)
    assert {r.doc_id: r.kept for r in got} == plain_verdicts([(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_rejected_documents_keep_clashing_columns(spark):
    docs = _hosts(spark).selectExpr("*", "doc_id as n_words", "source as kept", "1 as c0", "2 as host_key")
    out = quality.reject(docs)
    assert out.columns == docs.columns
    want = quality.with_verdict(_hosts(spark)).where("kept").count()
    assert out.count() == want == out.where("n_words = doc_id and kept = source and c0 = 1").count()
