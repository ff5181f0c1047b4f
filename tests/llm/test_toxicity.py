import math
import random

import pytest
from fixtures import ROWS
from sievetext.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_sentences_and_empty_texts():
    assert toxicity.sentences("One two. three!\n\n?? Four") == [[b"one", b"two"], [b"three"], [b"four"]]
    model = toxicity.Model({b"bad": 9.0}, -5.0)
    assert [model.score(t) for t in (None, "", " ?! ")] == [0.0, 0.0, 0.0]


def test_noisy_or():
    model = toxicity.Model({b"bad": 4.0}, -3.0)
    p, q = 1 / (1 + math.exp(-1.0)), 1 / (1 + math.exp(3.0))
    assert model.score("so bad. fine. bad bad") == pytest.approx(1 - (1 - p) ** 2 * (1 - q))
    assert [(a, b) for a, b, _ in model.locate("so bad. fine. bad")] == [(0, 6), (13, 17)]


def _made(n, seed):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(200)]
    out = []
    for _ in range(n):
        toxic = rng.random() < 0.3
        bag = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(rng.randint(1, 30))]
        if toxic:
            at = rng.randrange(len(bag))
            bag[at] = f"{bag[at]} {rng.choice(['scumbag', 'grotter', 'grottest'])}"
        out.append((". ".join(bag), int(toxic)))
    return out


def test_learns_the_words_of_offending_sentences_from_document_labels():
    train, test = _made(600, 1), _made(200, 2)
    model = toxicity.fit([toxicity.sentences(t) for t, _ in train], [y for _, y in train])
    for text, y in test:
        assert (model.score(text) >= 0.5) == bool(y)
        if y:
            spans = model.locate(text)
            assert any("scumbag" in text[a:b] or "grott" in text[a:b] for a, b, _ in spans) and len(spans) <= 2


def test_degenerate_training():
    bags = [toxicity.sentences("a b"), toxicity.sentences("c")]
    assert toxicity.fit([], []).score("x") == pytest.approx(0, abs=1e-9)
    assert toxicity.fit(bags, [0, 0]).score("a") < 1e-9 and toxicity.fit(bags, [1, 1]).score("a") > 1 - 1e-9


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity_digest(docs, labels).join(labels, "doc_id").where("held_out").collect()
    wrong = sum(r.predicted != r.toxic for r in rows)
    assert len(rows) > 500 and wrong <= 0.02 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all((r.n_toxic_sentences > 0) == (r.predicted == 1) for r in rows)


def test_scores_of_awkward_rows(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    model = toxicity.Model({b"river": 3.0}, -3.0)
    texts = {i: t for i, t, *_ in ROWS}
    got = toxicity.with_toxicity(docs, model).collect()
    assert len(got) == len(ROWS) and all(r.pii == "x" for r in got)
    for r in got:
        assert r.toxicity.score == pytest.approx(model.score(texts[r.doc_id]))


def test_rare_class_stays_in_the_sample(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(3000):
        bag = [" ".join(f"w{rng.randrange(200)}" for _ in range(8)) for _ in range(rng.randint(1, 6))]
        if i % 150 == 0:
            bag.append("you scumbag you")
        rows.append((i, ". ".join(bag)))
        labels.append((i, int(i % 150 == 0)))
    labels += [(-i, 0) for i in range(1, 3000)]  # without documents
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample_docs=120)
    got = {i: model.score(t) >= 0.5 for i, t in rows}
    assert all(got[i] for i in range(0, 3000, 150)) and sum(got.values()) <= 25


def test_long_documents_train_and_repeated_rows_count(spark):
    long = ". ".join(["river mill gate"] * 3000)
    rows = [(i, long + (". scumbag" if i % 2 else "")) for i in range(60)] * 2
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert len(long) > 30_000 and model.score(long) < 0.5 <= model.score(long + ". scumbag")


def test_sample_places():
    assert toxicity.sample_places([5] * 9, [5] * 9, 6, 1000) == ([0, 1, 2], [0, 1, 2])
    assert toxicity.sample_places([5] * 9, [5], 6, 1000) == ([0, 1, 2, 3, 4], [0])
    assert toxicity.sample_places([5], [5] * 9, 6, 1000) == ([0], [0, 1, 2, 3, 4])
    clean, toxic = toxicity.sample_places([40, 9, 200, 8], [70, 30, 90], 100, 100)
    assert (clean, toxic) == ([0, 1, 3], [1])
