"""The n-gram model against its formulas in plain dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import ROWS, documents, small
from sievetext.llm import ngrams

WORD = re.compile(r"[^\x20\x09-\x0d]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Model:
    def __init__(self, texts, order):
        """``texts``: (text, train)"""
        self.docs = [["<s>", *WORD.findall((t or "").translate(UP)), "</s>"] for t, _ in texts]
        raw = {k: Counter() for k in range(1, order + 1)}
        for d, (_, train) in zip(self.docs, texts, strict=True):
            for k in range(1, order + 1) if train else ():
                raw[k].update(tuple(d[i - k + 1:i + 1]) for i in range(max(1, k - 1), len(d)))
        self.order, self.words = order, raw[1]
        self.n, self.types = sum(raw[1].values()), len(raw[1])
        self.counts = {order: raw[order]}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
            if k > 1:
                self.counts[k].update({g: n for g, n in raw[k].items() if g[0] == "<s>"})
        self.d, self.context = {}, {}
        for k, counts in self.counts.items():
            t = Counter(counts.values())
            if min(t[1], t[2], t[3]) == 0:
                self.d[k] = [0, 0.5, 1, 1.5]
            else:
                y = t[1] / (t[1] + 2 * t[2])
                self.d[k] = [0] + [min(max(j - (j + 1) * y * t[j + 1] / t[j], 0), j) for j in (1, 2, 3)]
            self.context[k] = defaultdict(lambda: [0, 0, 0, 0])
            for g, n in counts.items():
                of = self.context[k][g[:-1]]
                of[0] += n
                of[min(n, 3)] += 1

    def p(self, gram):
        k = len(gram)
        lower = 1 / (self.types + 1) if k == 1 else self.p(gram[1:])
        total, *seen = self.context[k].get(gram[:-1], (0, 0, 0, 0))
        if not total:
            return lower
        n, d = self.counts[k][gram], self.d[k]
        return (n - d[min(n, 3)] + sum(x * y for x, y in zip(d[1:], seen, strict=True)) * lower) / total

    def row(self, i):
        d = self.docs[i]
        score = sum(math.log10(self.p(tuple(d[max(0, j - self.order + 1):j + 1]))) for j in range(1, len(d)))
        base = sum(math.log10((self.words[w,] + 1) / (self.n + self.types + 1)) for w in d[1:])
        return len(d) - 1, sum((w,) in self.words for w in d[1:]), self.n, base, score


def check(spark, rows, order, **sizes):
    """``rows``: (id, text, train)"""
    df = spark.createDataFrame(rows, "id long, text string, train boolean").repartition(5)
    got = {r.id: r for r in ngrams.scores(df, "train", ["id", "train"], order=order, **sizes).collect()}
    model = Model([r[1:] for r in rows], order)
    assert len(got) == len(rows)
    for k, (i, _, train) in enumerate(rows):
        n, known, total, base, score = model.row(k)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.train) == (n, known, total, train)
        assert r.base_score == pytest.approx(base, abs=1e-9) and r.score == pytest.approx(score, abs=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-score / n))
    return model


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_the_formulas(spark, order):
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in small(spark).collect()]
    rows += [(1000, None, True), (1001, "", False), (1002, "X x", True)]
    check(spark, rows, order, block_tokens=9000, shard_tokens=20_000)  # many blocks and shards


def test_probabilities_sum_to_one():
    texts = [("a b a c a b d e f a b a g c h h h", True), ("b a c d", True), ("a", True)]
    for order in (1, 2, 3):
        m = Model(texts, order)
        vocabulary = [w for w, in m.words] + ["unseen"]
        contexts = [(), ("a",), ("h",), ("unseen",), ("<s>",)] if order > 1 else [()]
        for c in contexts + ([("b", "a"), ("<s>", "a")] if order > 2 else []):
            if len(c) < order:
                assert sum(m.p((*c, w)) for w in vocabulary) == pytest.approx(1)


def test_sizes_change_nothing(spark):
    docs = small(spark).selectExpr("doc_id", "text", "doc_id % 3 > 0 as train")
    one = ngrams.scores(docs, "train", ["doc_id"], order=3).collect()
    two = ngrams.scores(docs.repartition(9), "train", ["doc_id"], order=3, block_tokens=500, shard_tokens=3000).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_without_training_rows_and_one_word_over_and_over(spark):
    m = check(spark, [(1, "a b", False), (2, None, False)], 2)
    assert m.n == 0
    check(spark, [(1, "x " * 5000, True), (2, "x y", False), (3, "y", True)], 3, block_tokens=100, shard_tokens=10)


def test_awkward_rows(spark):
    got = ngrams.score_digest(documents(spark, extra=True)).collect()
    model = Model([(t, zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2) for i, t, *_ in ROWS], 2)
    want = [(i, *model.row(k)) for k, (i, *_) in enumerate(ROWS)]
    key = lambda r: (str(r[0]), *(round(float(v), 4) for v in r[1:]))
    rows = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    assert sorted(map(key, rows)) == sorted(map(key, want))


def test_grams_of_one_hash_are_an_error():
    one = ngrams.pack(*[np.array(v, np.int64) for v in ([5], [6], [1])])
    two = ngrams.pack(*[np.array(v, np.int64) for v in ([7], [8], [1])])
    mix = ngrams.mix
    try:
        ngrams.mix = lambda a, b: np.zeros(len(a), np.uint64)
        with pytest.raises(ValueError, match="64-bit"):
            list(ngrams.answer(0, [(ngrams.ASK, 1, one), (ngrams.ASK, 2, two)], 2, 2, 1))
    finally:
        ngrams.mix = mix


def test_columns_come_back():
    rng = np.random.default_rng(5)
    wide = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for column in (wide, np.sort(wide), rng.choice(wide[:200], 3000), rng.choice(wide[:1], 50), wide[:1], wide[:0],
                   np.arange(9, dtype=np.uint64)[::-1], np.zeros(4, np.uint64)):
        data = ngrams.pack(column)
        assert (ngrams.unpack(data, 1)[0].view(np.uint64) == column).all()
        values, at = ngrams.unpack_values(data)
        assert (values[at] == column).all() and (values == np.unique(column)).all()


def test_pack_and_shards():
    a, b = np.arange(1000), np.arange(1000, dtype=np.uint64)[::-1]
    assert (ngrams.unpack(ngrams.pack(a, b), 2) == np.array([a, b.astype(np.int64)])).all()
    assert ngrams.unpack(ngrams.pack(a[:0]), 1).shape == (1, 0)
    h = np.sort(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    s = ngrams.shard_of(h, 7)
    assert (np.diff(s) >= 0).all() and set(s.tolist()) == set(range(7))
    with pytest.raises(ValueError):
        ngrams.scores(None, "train", [], order=0)
