"""Randomised properties checked against plain-Python statements of the rules
(SURVEY §5.3): framing, left padding, capped encoding, partition invariance."""

import random

import pytest
from pyspark.sql import functions as F

from sievetext.operators.encode import encode_capped, encode_fixed, pad_left
from sievetext.operators.noise import inject_noise
from sievetext.operators.vocab import frequency_index, token_counts, vocabulary, word_index

WORDS = ["a", "b", "c", "d", "e", "f", "g"]


def _random_docs(seed, n=150, max_len=20):
    rng = random.Random(seed)
    return [(i, [rng.choice(WORDS) for _ in range(rng.randint(0, max_len))]) for i in range(n)]


def _frame_py(tokens, index, L):
    ids = [1] + [index.get(t, 3) for t in tokens]
    if len(ids) >= L:
        return ids[:L - 1] + [2]
    return ids + [2] + [0] * (L - len(ids) - 1)


def _pad_py(seq, L):
    return ([0] * (L - len(seq)) + seq) if len(seq) < L else seq[len(seq) - L:]


@pytest.mark.parametrize("L", [2, 3, 7, 25])
def test_encode_fixed_matches_rule(spark, L):
    docs = _random_docs(L)
    df = spark.createDataFrame(docs, "id long, tokens array<string>")
    known = spark.createDataFrame([([w],) for w in WORDS[:5]], "tokens array<string>")
    idx = word_index(vocabulary(known))
    index = {r.token: r.id for r in idx.collect()}
    got = {r.id: r.ids for r in encode_fixed(df, idx, L).collect()}
    for i, toks in docs:
        assert got[i] == _frame_py(toks, index, L)


def test_pad_left_matches_rule(spark):
    rng = random.Random(3)
    seqs = [[rng.randint(1, 9) for _ in range(rng.randint(0, 12))] for _ in range(200)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id long, s array<long>")
    for L in (1, 5, 12):
        got = {r.id: r.p for r in df.select("id", pad_left("s", L).alias("p")).collect()}
        assert all(got[i] == _pad_py(s, L) for i, s in enumerate(seqs))


def test_encode_capped_matches_keras_rule(spark):
    docs = _random_docs(11, max_len=15)
    df = spark.createDataFrame(docs, "id long, tokens array<string>")
    findex = frequency_index(token_counts(df), specials=())
    index = {r.token: r.id for r in findex.collect()}
    counts = {}
    for _, toks in docs:
        for t in toks:
            counts[t] = counts.get(t, 0) + 1
    ranked = sorted(counts, key=lambda t: (-counts[t], t))
    assert index == {t: r + 4 for r, t in enumerate(ranked)}
    num_words, L = 8, 10
    got = {r.id: r.ids for r in encode_capped(df, findex, num_words, L).collect()}
    for i, toks in docs:
        seq = [1] + [index[t] if index[t] < num_words else 2 for t in toks]
        assert got[i] == _pad_py(seq, L)


def test_word_index_partition_invariant(spark):
    docs = _random_docs(5, n=300)
    df = spark.createDataFrame(docs, "id long, tokens array<string>")
    outs = []
    for parts in (1, 3, 8):
        idx = word_index(vocabulary(df.repartition(parts)), num_partitions=parts)
        outs.append(sorted((r.token, r.id) for r in idx.collect()))
    assert outs[0] == outs[1] == outs[2]


@pytest.mark.parametrize("ratio", [0.1, 0.3, 0.77])
def test_noise_counts(spark, ratio):
    n = 997
    df = spark.range(n).select("id", (F.col("id") % 5).cast("int").alias("label"))
    noisy = n - int((1.0 - ratio) * n)
    exc = inject_noise(df, 5, ratio, "exc").agg(F.sum(F.col("is_flipped").cast("int"))).first()[0]
    inc = inject_noise(df, 5, ratio, "inc").agg(F.sum(F.col("is_flipped").cast("int")),
                                               F.sum(F.col("is_noisy_row").cast("int"))).first()
    assert exc == noisy and inc[1] == noisy and inc[0] <= noisy


def test_split_lookup_equals_plain_join(spark):
    from sievetext.operators.encode import word_ids
    from sievetext.plans.prepare import prepare

    p = prepare(spark, "/root/testdata/sf0.001")
    plain = {r.id: r.ids for r in encode_fixed(p.tokens, p.index, 64).collect()}
    split = {r.id: r.ids for r in encode_fixed(p.tokens, p.index, 64, hot=p.hot_index(50)).collect()}
    assert plain == split
    whole = {r.id: r.ids for r in word_ids(p.tokens, p.index).collect()}
    whole_split = {r.id: r.ids for r in word_ids(p.tokens, p.index, hot=p.hot_index(10)).collect()}
    assert whole == whole_split


def test_split_lookup_for_decode_and_cnn_gather(spark):
    from sievetext.operators.cnn import CNNRunner, CNNText
    from sievetext.operators.encode import decode_ids
    from sievetext.plans.features import Vectors
    from sievetext.plans.prepare import prepare

    p = prepare(spark, "/root/testdata/sf0.001")
    enc = encode_fixed(p.tokens, p.index, 24, keep=("y",))
    hot = p.hot_index(30)
    assert hot.where("id < 4").count() == 4
    a = {r.id: r.tokens for r in decode_ids(enc, p.index).collect()}
    b = {r.id: r.tokens for r in decode_ids(enc, p.index, hot=hot).collect()}
    assert a == b
    v = Vectors(p)
    hot_vecs = v.lookup.join(hot.select("id"), "id", "left_semi")
    m = CNNText(p.num_classes, v.dim)
    x = {r.id: r.probs for r in CNNRunner(enc, v.lookup, v.dim, 24, budget=0).score(m).collect()}
    y = {r.id: r.probs for r in CNNRunner(enc, v.lookup, v.dim, 24, budget=0, hot=hot_vecs).score(m).collect()}
    assert max(abs(s - t) for i in x for s, t in zip(x[i], y[i])) < 1e-12
