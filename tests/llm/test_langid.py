import numpy as np
import pytest
from fixtures import ROWS
from sievetext.llm import langid

SF = "/root/testdata/sf0.1"


def one_by_one(scores, transitions):
    """Marginals of one chain, word by word."""
    k = scores.shape[1]
    e, t = np.exp(scores), np.exp(transitions)
    forward, state = [], np.full(k, 1 / k)
    for row in e:
        state = (state @ t) * row
        state = state / state.sum()
        forward.append(state)
    backward, state = [], np.ones(k)
    for row in e[::-1]:
        backward.append(state)
        state = t @ (row * state)
        state = state / state.sum()
    p = np.array(forward) * np.array(backward[::-1])
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("sizes", [[1], [5, 1], [32, 33, 1, 64], [200, 31, 97]])
def test_marginals(sizes):
    rng = np.random.default_rng(len(sizes))
    k = 3
    scores, transitions = rng.normal(size=(sum(sizes), k)) * 2, rng.normal(size=(k, k))
    got = langid.marginals(scores, np.array(sizes), transitions)
    at = 0
    for n in sizes:
        assert np.abs(got[at:at + n] - one_by_one(scores[at:at + n], transitions)).max() < 1e-9
        at += n


def test_pair_gradient_is_the_derivative():
    rng = np.random.default_rng(4)
    k, size, n = 3, 6, 4
    scores, tr = rng.normal(size=(n * size, k)), rng.normal(size=(k, k))
    y, lengths = rng.integers(0, k, n * size), np.full(n, size)

    def loss(s, t):
        total = 0.0
        for c in range(n):
            part, lab = s[c * size:(c + 1) * size], y[c * size:(c + 1) * size]
            state = np.full(k, 1 / k)
            norm = 0.0
            for row in part:
                state = (state @ np.exp(t)) * np.exp(row)
                norm += np.log(state.sum())
                state = state / state.sum()
            path = np.log(np.exp(t[:, lab[0]]).mean()) + part[np.arange(size), lab].sum()
            total += norm - path - sum(t[a, b] for a, b in zip(lab, lab[1:], strict=False))
        return total

    p, grad = langid._pair_gradient(scores, y, lengths, tr)
    onehot = np.eye(k)[y]
    eps = 1e-6
    i, j = 2, 1
    up, down = scores.copy(), scores.copy()
    up[i, j] += eps
    down[i, j] -= eps
    assert (loss(up, tr) - loss(down, tr)) / (2 * eps) == pytest.approx((p - onehot)[i, j], abs=1e-5)
    # Pairs inside the chains; the free first label adds its own small part.
    assert abs(grad.sum()) < 1e-9


def test_words_and_features():
    f = langid.Featurizer()
    w = f(["Ab c, déf", "", "1 x2y"])
    assert w.text.tolist() == [0, 0, 0, 2, 2] and w.length.tolist() == [2, 1, 3, 1, 1]
    same = f(["xx ab ab"])
    assert same.key[1] == same.key[2] != same.key[0]
    start, chars, ends = same.slots(np.array([1, 2]))
    assert start.tolist() == [0, 2] and all(c[0] == c[2] and c[1] == c[3] for c in chars) and len(ends) == 6


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    wrong = sum(r.lang_pred != r.lang for r in rows)
    assert len(rows) > 2500 and wrong <= 0.005 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switched_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = langid.train(docs)
    by = {lang: docs.where(f"lang = '{lang}' and n_chars between 600 and 3000").orderBy("doc_id").first().text
          for lang in ("de", "fr")}
    mixed = " ".join(by["de"].split()[:40] + by["fr"].split()[:40])
    got = langid.label_texts(field, langid.Featurizer(), [mixed])[0]
    mix = {m["lang"]: m["words"] for m in got["mix"]}
    assert mix["de"] >= 32 and mix["fr"] >= 32 and got["switches"] <= 6


def test_no_letters_and_no_training():
    field = langid.fit(["the cat sat on the mat and " * 9, "der hund und die katze im haus " * 9] * 4, ["en", "de"] * 4)
    got = langid.label_texts(field, langid.Featurizer(), [None, "", "12 ?!", "the cat and the mat"])
    assert [g["lang"] for g in got] == ["und", "und", "und", "en"] and got[0]["score"] == 0.0
    empty = langid.fit([], [])
    assert langid.label_texts(empty, langid.Featurizer(), ["the"])[0]["lang"] == "und"
    alone = langid.fit(["the cat"], ["en"])
    assert langid.label_texts(alone, langid.Featurizer(), ["a dog"])[0]["lang"] == "en"


def test_long_text_equals_its_parts_grouping():
    field = langid.fit(["the cat sat on the mat and " * 9, "der hund und die katze im haus " * 9] * 4, ["en", "de"] * 4)
    texts = [t or "" for _, t, *_ in ROWS]
    whole = langid.label_texts(field, langid.Featurizer(), texts)
    single = [langid.label_texts(field, langid.Featurizer(), [t])[0] for t in texts]
    assert [w["lang"] for w in whole] == [s["lang"] for s in single]
    assert np.allclose([w["score"] for w in whole], [s["score"] for s in single], atol=1e-5)


def _short(words, n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(words, rng.integers(3, 21))) for _ in range(n)]


def test_languages_of_short_texts():
    en = "the cat sat on a mat and then it went out into rain with some old friends".split()
    de = "der hund und die katze im haus sind nicht mehr da weil es regnet heute".split()
    ja = "今日は 天気が いいです 明日も また 会いましょう 駅まで 歩いて 行きます".split()
    short = [t for v in (de, ja) for t in _short(v, 40, 1)]
    names = ["de"] * 40 + ["ja"] * 40
    test = [t for v in (en, de, ja) for t in _short(v, 10, 2)]
    want = ["en"] * 10 + ["de"] * 10 + ["ja"] * 10
    # English has only long texts, then only short ones as the others have.
    for texts in ([" ".join(_short(en, 60, 3))] * 3, _short(en, 40, 3)):
        field = langid.fit(texts + short, ["en"] * len(texts) + names)
        got = langid.label_texts(field, langid.Featurizer(), test)
        assert [g["lang"] for g in got] == want


@pytest.mark.parametrize("k", [17, 40])
def test_marginals_of_many_languages(k):
    rng = np.random.default_rng(k)
    sizes = [langid.block_words(k) * 2 + 5, 1, langid.block_words(k)]
    scores, transitions = rng.normal(size=(sum(sizes), k)) * 2, rng.normal(size=(k, k))
    got, at = langid.marginals(scores, np.array(sizes), transitions), 0
    for n in sizes:
        assert np.abs(got[at:at + n] - one_by_one(scores[at:at + n], transitions)).max() < 1e-9
        at += n


def test_memory_of_a_hundred_languages():
    import tracemalloc

    k = 100
    field = langid.Field([f"l{i:03}" for i in range(k)], np.zeros(((1 << langid.BITS) + k + 1, k), np.float32),
                         np.full(1 << langid.LEXICON_BITS, -1, np.int16), np.zeros((k, k)))
    rng = np.random.default_rng(1)
    words = np.array(["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)])
    text = " ".join(rng.choice(words, 350_000))  # 2 MB, one text
    featurize = langid.Featurizer()
    tracemalloc.start()
    got = langid.label_texts(field, featurize, [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0]["words"] == 350_000 and peak < 1 << 30


def test_sample_of_whole_texts_and_too_many_languages(spark, monkeypatch):
    seen = []
    plain = langid.fit
    monkeypatch.setattr(langid, "fit", lambda texts, labels: seen.append((texts, labels)) or plain(texts, labels, steps=1))
    header = "this licence is given to all people who use the work " * 60  # over 3,000 characters
    rows = [(i, header + ("der hund und die katze " if i % 2 else "le chat et le chien ") * 30, "de" if i % 2 else "fr")
            for i in range(60)] + [(1000 + i, "x" * 50_000 + " y", "long") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.train(docs, sample_chars=60_000)
    texts, labels = seen[0]
    by_id = {t for _, t, _ in rows}
    assert set(texts) <= by_id and {"de", "fr", "long"} == set(labels)
    assert labels.count("long") == 1  # all are beyond the share; the shortest drawn is learned
    for lang in ("de", "fr"):
        assert sum(len(t) for t, v in zip(texts, labels, strict=True) if v == lang) <= 20_000
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs, max_languages=2)
