import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import ROWS, documents
from pyspark.sql import functions as F
from sievetext.llm import collocations as co

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, max_words=5, absorb=100):
    """Straight from the definitions, in Python's whole numbers."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UP)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + m])) for m in range(1, max_words + 1) for i in range(len(w) - m + 1))
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= min_count}
    out = {}
    for (lang, p), a in found.items():
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(g == lang and len(q) > len(p) and 100 * b >= absorb * a
                     and any(q[i:i + len(p)] == p for i in range(len(q))) for (g, q), b in found.items())
        if not inside:
            out[lang, " ".join(p)] = (a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score)
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string").repartition(4)


def got(df):
    return {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["The", "cat", "sat", "on", "ÉTÉ", "é", "x" * 300, "日本", "a\x1cb", "\x00"]
    out = []
    for k in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ".", "\n", ", "]) for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "fr", None, "und"]), text if k % 17 else None))
    return out + [("en", "The cat sat on " * 40)] * 3


@pytest.mark.parametrize("min_count,absorb", [(3, 100), (12, 60)])
def test_equals_brute_force(spark, rows, min_count, absorb):
    want = brute(rows, min_count, absorb=absorb)
    assert len(want) > 20
    assert got(co.collocations(table(spark, rows), min_count=min_count, absorb_percent=absorb)) == want


def test_blocks_change_nothing(spark, rows):
    want = got(co.collocations(table(spark, rows), min_count=4))
    assert got(co.collocations(table(spark, rows), min_count=4, block_words=3, block_phrases=7)) == want == brute(rows, 4)


def test_awkward_rows(spark):
    want = brute([(lang, t) for _, t, lang, _ in ROWS], 2)
    assert got(co.collocations(documents(spark, extra=True), min_count=2)) == want


@pytest.mark.parametrize("seed", range(8))
def test_trie_equals_a_set(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 5, 60, 2000])
    codes = rng.sample(range(1, 10**9), rng.choice([2, 8, 400]))
    phrases = list({tuple(rng.choice(codes) for _ in range(rng.randint(1, 5))) for _ in range(n)})
    matrix = np.array([list(p) + [0] * (5 - len(p)) for p in phrases], np.int64)
    trie = co.compile_trie(matrix, np.arange(len(phrases)) + 10)
    assert len(np.unique(trie.check[trie.check >= 0])) <= len(trie.check)
    row = [rng.choice([*codes, *codes, 0, 7]) for _ in range(500)]
    for p in phrases[:50]:
        row += [*p, 0]
    row = np.array([*row, 0], np.int64)
    met = Counter()
    for start, state in trie.walk(row, 5):
        for s, at in zip(start.tolist(), trie.accept[state].tolist()):
            if at >= 0:
                met[s, at - 10] += 1
    number = {p: i for i, p in enumerate(phrases)}
    want = Counter((i, number[tuple(row[i:i + m].tolist())]) for i in range(len(row)) for m in range(1, 6)
                   if tuple(row[i:i + m].tolist()) in number)
    assert met == want


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**15
    phrases = spark.createDataFrame([(9, "en", [1, 2], "a b")], "cid long, lang string, codes array<long>, phrase string")
    vocab = spark.createDataFrame([(1, "en", "a", big + 1), (2, "en", "b", big + 7)], "code long, lang string, word string, n long")
    counts = spark.createDataFrame([(9, big)], "cid long, n long")
    sizes = spark.createDataFrame([("en", 9 * 10**18)], "lang string, n long")
    row = co.scored(phrases, counts, vocab, sizes, 100).first()
    assert row.score == 1000 * big * 9 * 10**18 // ((big + 1) * (big + 7))


def test_words_of_one_hash_are_an_error(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(co, "word_hash", lambda: F.lit(5).cast("long"))
    counted = spark.createDataFrame([("en", b"a", 100), ("en", b"b", 1)], "lang string, word binary, n long")
    with pytest.raises(ValueError, match="two words"):
        co.vocabulary(counted, 100)


def test_top_per_language(spark, monkeypatch):
    rows = [(lang, f"w{k} v{k}. " * (k + 2)) for lang in ("de", "en") for k in range(6)]
    plain = co.collocations
    monkeypatch.setattr(co, "collocations", lambda docs: plain(docs, min_count=2))
    out = co.collocation_digest(table(spark, rows), top=3).collect()
    assert sorted((r.lang, r["rank"]) for r in out) == [(g, i) for g in ("de", "en") for i in (1, 2, 3)]
    for lang in ("de", "en"):
        keys = [(-r.score, -r.a, r.phrase) for r in sorted(out, key=lambda r: r["rank"]) if r.lang == lang]
        assert keys == sorted(keys)


def test_tries_of_many_phrases_are_small_and_few(spark):
    """Two passes over the codes for 1.2 million phrases, and tries that the driver
    compiles at once (200,000 phrases took it 10 s each, a pass for every one)."""
    import time

    rng = np.random.default_rng(1)
    draw = lambda: np.minimum((400_000 ** rng.random(300_000)).astype(np.int64), 400_000)
    matrix = np.unique(np.stack([draw(), draw()], 1), axis=0)
    start = time.process_time()
    trie = co.compile_trie(matrix, np.arange(len(matrix)))
    assert time.process_time() - start < 5
    assert sum(a.nbytes for a in (trie.base, trie.check, trie.accept)) < 80 * len(matrix)
    row = np.append(np.insert(matrix[:1000], 2, 0, axis=1).ravel(), 0)
    _, (start, state) = list(trie.walk(row, 2))
    assert start.tolist() == list(range(0, 3000, 3)) and trie.accept[state].tolist() == list(range(1000))

    phrases = spark.range(1_200_000).select(F.array(F.col("id") % 1000, F.col("id")).alias("codes"))
    assert len(co._blocks(phrases, co.BLOCK_PHRASES)) == 2


def test_beginnings_are_in_one_block(spark):
    phrases = spark.createDataFrame([([a, b, c],) for a in (1, 2, 3) for b in (1, 2, 3) for c in range(1, 9)], "codes array<long>")
    parts = [{tuple(r.codes[:2]) for r in part.collect()} for part in co._blocks(phrases, 10)]
    assert sum(map(len, parts)) == 9 and len([p for p in parts if p]) > 1
