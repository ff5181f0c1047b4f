"""Word vectors, losses, selection, gradients and learning (FIXTURES.md B, SURVEY §5)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievetext.functions.vecmath import argmax, log_softmax, negative_nll, nll, softmax
from sievetext.operators.model import SoftmaxHead, gradient, score
from sievetext.operators.selection import confident_rows, selection_threshold
from sievetext.operators.vectors import lookup_table, mean_pool, read_word_vectors
from sievetext.operators.vocab import word_index
from sievetext.session import scratch_path


def test_losses_fixture(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4], 3, 1)], "p array<double>, y int, k int")
    r = df.select(nll("p", "y").alias("pos"), negative_nll("p", "k").alias("neg"),
                  negative_nll("p", "k", "as_written").alias("w")).first()
    assert round(r.pos, 6) == 0.916291
    assert round(r.neg, 6) == 0.223144
    assert round(r.w, 6) == -2.609438


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -2.0],)], "z array<double>")
    r = df.select(softmax("z").alias("p"), log_softmax("z").alias("l"), argmax("z").alias("a")).first()
    assert abs(sum(r.p) - 1.0) < 1e-12
    assert all(abs(math.log(p) - l) < 1e-12 for p, l in zip(r.p, r.l))
    assert r.a == 1  # first of the tied maxima


def test_selection_fixture(spark):
    df = spark.createDataFrame([(0, [0.25, 0.25, 0.25, 0.25], 0), (1, [0.2500001, 0.25, 0.25, 0.2499999], 0)],
                               "id long, probs array<double>, y int")
    t = selection_threshold("selnl", 4)
    assert [r.id for r in confident_rows(df, t).collect()] == [1]
    assert confident_rows(df, 0.0).count() == 2 and confident_rows(df, 1.0).count() == 0


def test_word_vectors_fixture(spark):
    path = scratch_path(spark, "wv-fixture")
    spark.createDataFrame([("a 1 0",), ("b 0 1",), ("a 2 0",), ("400 2",)], "value string") \
        .coalesce(1).write.text(path)
    vocab = spark.createDataFrame([("a",), ("hello",), ("400",)], "token string")
    vecs, info = read_word_vectors(spark, path, vocab=vocab)
    got = {r.token: r.vec for r in vecs.collect()}
    assert got == {"a": [2.0, 0.0]} and info["dropped_length"] == 1
    look = {r.token: r.vec for r in lookup_table(word_index(vocab), vecs, 2).collect()}
    unk = look["<UNK>"]
    assert look["a"] == [2.0, 0.0] and look["hello"] == unk and look["<PAD>"] == [0.0, 0.0]


def test_malformed_vector_raises(spark):
    path = scratch_path(spark, "wv-bad")
    spark.createDataFrame([("a 1 0",), ("b x 1",)], "value string").coalesce(1).write.text(path)
    with pytest.raises(ValueError):
        read_word_vectors(spark, path)
    vecs, info = read_word_vectors(spark, path, on_error="drop")
    assert [r.token for r in vecs.collect()] == ["a"] and info["malformed"] == 1


def test_mean_pool_empty_and_unknown(spark):
    table = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "token string, vec array<double>")
    df = spark.createDataFrame([(0, ["a", "b"]), (1, []), (2, ["a", "zz"])], "id long, tokens array<string>")
    got = {r.id: r.features for r in mean_pool(df, table, 2, unk=F.array(F.lit(9.0), F.lit(9.0))).collect()}
    assert got == {0: [2.0, 3.0], 1: [0.0, 0.0], 2: [5.0, 5.5]}


def _toy(spark, n=300, d=5, c=3, parts=4):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(n, d))
    y = rng.integers(0, c, n)
    comp = (y + 1 + rng.integers(0, c - 1, n)) % c
    rows = [(i, X[i].tolist(), int(y[i]), int(comp[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, features array<double>, y int, comp int").repartition(parts)
    return df, X, y, comp


def _loss_np(m, X, y, comp, kind):
    P = m.probs(X)
    r = np.arange(len(y))
    if kind == "pl":
        return -np.log(P[r, y]).mean()
    return -np.log(1 - P[r, comp]).mean()


@pytest.mark.parametrize("kind", ["pl", "nl"])
def test_gradient_matches_finite_differences(spark, kind):
    df, X, y, comp = _toy(spark)
    rng = np.random.default_rng(2)
    m = SoftmaxHead(rng.normal(size=(3, 5)) * 0.3, rng.normal(size=3) * 0.1)
    g = gradient(df, m, kind=kind, comp_col="comp" if kind == "nl" else None)
    assert g["n"] == 300
    f = m.flat()
    num = np.zeros_like(f)
    for i in range(len(f)):
        a, b = f.copy(), f.copy()
        a[i] += 1e-6
        b[i] -= 1e-6
        num[i] = (_loss_np(SoftmaxHead.from_flat(a, 3, 5), X, y, comp, kind)
                  - _loss_np(SoftmaxHead.from_flat(b, 3, 5), X, y, comp, kind)) / 2e-6
    assert np.abs(num - g["grad"]).max() < 1e-6
    assert abs(g["loss"] - _loss_np(m, X, y, comp, kind)) < 1e-9


def test_gradient_partition_invariant_and_scores_sum_to_one(spark):
    df, X, y, comp = _toy(spark)
    m = SoftmaxHead(np.ones((3, 5)) * 0.1)
    g1 = gradient(df.repartition(1), m, kind="pl")["grad"]
    g8 = gradient(df.repartition(8), m, kind="pl")["grad"]
    assert np.abs(g1 - g8).max() < 1e-12
    sums = [sum(r.probs) for r in score(df, m).collect()]
    assert all(abs(s - 1) < 1e-12 for s in sums)


def test_nl_equals_pl_for_two_classes(spark):
    rows = [(i, [float(i % 3), 1.0], i % 2, 1 - i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, features array<double>, y int, comp int")
    m = SoftmaxHead(np.array([[0.3, -0.1], [0.2, 0.4]]))
    pl = gradient(df, m, kind="pl")
    nl = gradient(df, m, kind="nl", comp_col="comp")
    assert abs(pl["loss"] - nl["loss"]) < 1e-12 and np.abs(pl["grad"] - nl["grad"]).max() < 1e-12


def test_three_stage_cleaning_learns(spark):
    from sievetext.plans.nlnl import NLNLConfig, run_nlnl, scored_rows

    res = run_nlnl(spark, "/root/testdata/sf0.01", NLNLConfig(nl_epochs=8, selnl_epochs=6, selpl_epochs=6))
    h = res.history
    assert h[-1]["train_loss"] < h[0]["train_loss"]
    s = scored_rows(res).agg(F.avg((~F.col("is_flipped")).cast("double")).alias("all"),
                             F.avg(F.when(F.col("kept"), (~F.col("is_flipped")).cast("double"))).alias("kept")).first()
    assert s.kept > s.all


@pytest.mark.parametrize("how", ["mean", "attention"])
def test_pool_local_equals_join(spark, how):
    from sievetext.operators.vectors import attention_pool
    from sievetext.plans.features import Vectors
    from sievetext.plans.prepare import prepare

    p = prepare(spark, "/root/testdata/sf0.001")
    v = Vectors(p)
    fn = mean_pool if how == "mean" else attention_pool
    none = spark.createDataFrame([(-1, None), (-2, [])], "id long, tokens array<string>")
    rows = p.tokens.select("id", "tokens").unionByName(none)
    for cut in (None, 40):  # whole texts, and cut ones
        a = {r.id: r.features for r in fn(rows, v.token_vecs, v.dim, max_items=cut, unk=v.unk,
                                          method="local").collect()}
        b = {r.id: r.features for r in fn(rows, v.token_vecs, v.dim, max_items=cut, unk=v.unk,
                                          method="join").collect()}
        assert a.keys() == b.keys() and -1 in a
        assert a[-1] == a[-2] == b[-1] == b[-2] == [0.0] * v.dim
        assert max(abs(x - y) for i in a for x, y in zip(a[i], b[i])) < 1e-9


def test_lookup_table_of_many_vectors_has_one_row_per_id(spark):
    """A vector table of many more rows than one partition holds."""
    from sievetext.operators.vectors import assign_vectors, embedding_rows, lookup_table
    from sievetext.plans.prepare import prepare

    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    many = spark.range(100).withColumnRenamed("id", "k").join(emb, F.lit(True)).select(
        (F.col("vec_id") * 100 + F.col("k")).alias("vec_id"), "embedding")
    n = many.count()
    rows = embedding_rows(many)
    assert rows.select("row").distinct().count() == n and rows.agg(F.max("row")).first()[0] == n - 1
    p = prepare(spark, "/root/testdata/sf0.001")
    table = lookup_table(p.index, assign_vectors(p.vocab_all, many), 64)
    assert table.count() == p.index.count() == table.select("id").distinct().count()


def test_pool_split_lookup_equals_plain_join(spark):
    from sievetext.plans.features import Vectors
    from sievetext.plans.prepare import prepare

    p = prepare(spark, "/root/testdata/sf0.001")
    v = Vectors(p)
    hot = v.hot_vecs(budget=20 * (8 * v.dim + 64))  # 20 hot words
    assert hot.count() == 20
    a = {r.id: r.features for r in mean_pool(p.tokens, v.token_vecs, v.dim, max_items=40, unk=v.unk,
                                             method="join").collect()}
    b = {r.id: r.features for r in mean_pool(p.tokens, v.token_vecs, v.dim, max_items=40, unk=v.unk,
                                             method="join", hot=hot).collect()}
    assert max(abs(x - y) for i in a for x, y in zip(a[i], b[i])) < 1e-9


def test_as_written_gradient_matches_finite_differences(spark):
    df, X, y, comp = _toy(spark)
    m = SoftmaxHead(np.random.default_rng(5).normal(size=(3, 5)) * 0.3)
    g = gradient(df, m, kind="nl", form="as_written", comp_col="comp")

    def loss(mod):
        P = mod.probs(X)
        return (np.log(P[np.arange(len(y)), comp]) - 1.0).mean()

    f = m.flat()
    num = np.zeros_like(f)
    for i in range(len(f)):
        a, b = f.copy(), f.copy()
        a[i] += 1e-6
        b[i] -= 1e-6
        num[i] = (loss(SoftmaxHead.from_flat(a, 3, 5)) - loss(SoftmaxHead.from_flat(b, 3, 5))) / 2e-6
    assert np.abs(num - g["grad"]).max() < 1e-6


def test_cnn_gradient_matches_finite_differences():
    from sievetext.operators.cnn import CNNText, dropout_mask
    from sievetext.operators.model import softmax_np

    rng = np.random.default_rng(0)
    m = CNNText(3, 4, sizes=(2, 3), n_filters=2, dropout=0.2)
    X = rng.normal(size=(5, 7, 4))
    y = np.array([0, 1, 2, 1, 0])
    mask = dropout_mask(np.arange(5), 4, 0.2, 7, 1)

    def loss(mod):
        h, _ = mod.features(X)
        P = softmax_np((h * mask) @ mod.params["fc"].T + mod.params["fc_b"])
        return -np.log(P[np.arange(5), y]).sum()

    h, cache = m.features(X)
    P = softmax_np((h * mask) @ m.params["fc"].T + m.params["fc_b"])
    dZ = P.copy()
    dZ[np.arange(5), y] -= 1
    g = m.backward(X, dZ, h, mask, cache)
    f = m.flat()
    num = np.zeros_like(f)
    for i in range(len(f)):
        a, b = f.copy(), f.copy()
        a[i] += 1e-6
        b[i] -= 1e-6
        num[i] = (loss(m.with_flat(a)) - loss(m.with_flat(b))) / 2e-6
    assert np.abs(num - g).max() < 1e-6


def test_cnn_join_path_equals_broadcast_path(spark):
    from sievetext.operators.cnn import CNNRunner, CNNText
    from sievetext.plans.features import Vectors
    from sievetext.plans.prepare import prepare
    from sievetext.operators.encode import encode_fixed

    p = prepare(spark, "/root/testdata/sf0.001")
    v = Vectors(p)
    enc = encode_fixed(p.tokens, p.index, 24, keep=("y",))
    model = CNNText(p.num_classes, v.dim)
    a = {r.id: r.probs for r in CNNRunner(enc, v.lookup, v.dim, 24).score(model).collect()}
    runner = CNNRunner(enc, v.lookup, v.dim, 24, budget=0)
    assert runner.bc is None
    b = {r.id: r.probs for r in runner.score(model).collect()}
    assert a.keys() == b.keys()
    assert max(abs(x - y) for i in a for x, y in zip(a[i], b[i])) < 1e-9
    ga = CNNRunner(enc, v.lookup, v.dim, 24).gradient_frame(model, kind="pl").first()
    gb = runner.gradient_frame(model, kind="pl").first()
    assert ga["n"] == gb["n"] and abs(ga["loss"] - gb["loss"]) < 1e-8


def test_trainer_resume_reproduces_uninterrupted_run(spark):
    from sievetext.plans.train import Adam, Trainer

    df, X, y, comp = _toy(spark, n=120)
    full = Trainer(3, 5, Adam(lr=0.1))
    full.fit(df, 6, "nl")
    path = scratch_path(spark, "trainer-state")
    first = Trainer(3, 5, Adam(lr=0.1))
    first.fit(df, 4, "nl", state_path=path, save_every=2)
    resumed = Trainer(3, 5, Adam(lr=0.1))
    assert resumed.load_state(spark, path) and len(resumed.history) == 4
    resumed.fit(df, 2, "nl")
    assert np.abs(resumed.model.flat() - full.model.flat()).max() < 1e-12
    assert [h["step"] for h in resumed.history] == [1, 2, 3, 4, 5, 6]


def test_named_passes(spark):
    from sievetext.plans import train as T

    df, X, y, comp = _toy(spark, n=90)
    tr = T.Trainer(3, 5, T.Adam(lr=0.1))
    neg, pos = T.train_nl(df, tr)
    assert neg == tr.history[-1]["train_loss"] and pos > 0
    loss = T.train_pl(df, tr)
    assert abs(T.evaluate_pl(df, tr.model) - _loss_np(tr.model, X, y, comp, "pl")) < 1e-9
    assert loss > 0 and T.evaluate_nl(df, tr.model, 3, epoch=1) > 0
    assert 0.0 <= T.test_accuracy(df, tr.model) <= 100.0
    assert T.threshold_data(df, tr.model, 1.0) is None
    kept = T.threshold_data(df, tr.model, 0.0)
    assert kept.count() == 90 and "features" in kept.columns


def test_empty_selection_stops_the_stage(spark):
    from sievetext.plans.train import Adam, Trainer

    df, X, y, comp = _toy(spark, n=60)
    tr = Trainer(3, 5, Adam(lr=0.1))
    before = tr.model.flat().copy()
    tr.fit(df, 5, "pl", select="selpl", gamma=1.0, dev=df)
    assert len(tr.history) == 1 and tr.history[0]["stopped"] and tr.history[0]["n_rows"] == 0
    assert np.array_equal(before, tr.model.flat())


def test_three_training_steps_select_and_clip(spark):
    from sievetext.queries import QUERIES

    r = QUERIES["three_training_steps"](spark, "/root/testdata/sf0.01").first()
    assert r.clipped and 0 < r.n_selpl < r.n_selnl < 500


def test_cnn_selection_does_not_depend_on_the_epoch(spark):
    """Rows are chosen without dropout, whatever mask the epoch trains with."""
    from sievetext.operators.cnn import CNNRunner, CNNText

    rng = np.random.default_rng(3)
    enc = spark.createDataFrame([(i, i % 3, rng.integers(0, 30, 12).tolist()) for i in range(200)],
                                "id long, y int, ids array<long>")
    lookup = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(30)], "id long, vec array<double>")
    runner, model = CNNRunner(enc, lookup, 6, 12), CNNText(3, 6, dropout=0.5)
    kept = [runner.gradient_frame(model, kind="pl", epoch=e, threshold=0.34).first()["n"] for e in (1, 2, 3)]
    probs = {r.id: r.probs[r.y] for r in runner.score(model).collect()}
    assert kept == [sum(p > 0.34 for p in probs.values())] * 3


def test_gradient_sums_in_two_levels(spark):
    from sievetext.operators.model import gradient_frame

    df, _, y, _ = _toy(spark)
    out = gradient_frame(df.repartition(7), SoftmaxHead.zeros(3, 5))
    assert out.first()["n"] == len(y)
    assert out._jdf.queryExecution().executedPlan().toString().count("ObjectHashAggregate") >= 4 or \
        out._jdf.queryExecution().executedPlan().toString().count("HashAggregate") >= 4


def test_null_label_is_missing_for_any_number_of_classes(spark):
    from sievetext.operators.labels import encode_labels

    for n in (4, 100):
        labels = [f"l{i:03d}" for i in range(n)]
        df = spark.createDataFrame([(labels[1],), (None,), ("other",)], "label string")
        with pytest.raises(KeyError, match="2 rows"):
            encode_labels(df, labels)
        assert encode_labels(df, labels, strict=False).count() == 1


def test_vector_file_lines(spark, tmp_path):
    r"""Only \n ends a line; bytes that are not UTF-8 are ignored."""
    (tmp_path / "v.txt").write_bytes(b"a\rb 1 2\nc\xff 3 4\n2 2\nd 5 6\nd 7 8\n")
    got, info = read_word_vectors(spark, str(tmp_path / "v.txt"))
    rows = {r.token: r.vec for r in got.collect()}
    assert rows == {"a\rb": [1.0, 2.0], "c": [3.0, 4.0], "d": [7.0, 8.0]} and info["dropped_length"] == 1


def test_multiclass_sequences(spark):
    from sievetext import compat

    rows = spark.createDataFrame([(i, i % 3, ["a"] * (i + 1) + ["b"]) for i in range(10)],
                                 "id long, y int, tokens array<string>")
    train, train_set, test_set, padded, index = compat.load_data_set_multiclass(
        rows.where("id < 7"), rows.where("id >= 7"), max_len=4, vocab_size=5, batch_size=3)
    assert {r.token: r.id for r in index.collect()} == {"<PAD>": 0, "<START>": 1, "<UNK>": 2, "<EOS>": 3, "a": 4, "b": 5}
    assert train.count() == 6 and test_set.count() == 3 and padded.count() == 3
    assert train_set.where("id = 0").first()["ids"] == [1, 4, 2]


def test_history_has_the_reported_loss_and_train_accuracy(spark):
    from sievetext.plans.train import Trainer, history_frame

    df, _, y, _ = _toy(spark)
    tr = Trainer(3, 5)
    tr.fit(df, 5, "pl")
    rows = history_frame(spark, tr.history).collect()
    assert rows[0].reported_loss == pytest.approx(rows[0].train_loss / len(y))
    assert rows[0].train_accuracy is None and 0 <= rows[4].train_accuracy <= 100
