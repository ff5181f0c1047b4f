"""Edge cases of SURVEY §5.6: empty table, empty / null text, single class,
ratio 0 and 1, unknown label, empty selection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievetext.functions.text import tokenize
from sievetext.operators.encode import encode_fixed
from sievetext.operators.labels import collect_labels, encode_labels
from sievetext.operators.metrics import epoch_loss
from sievetext.operators.model import SoftmaxHead, gradient, score
from sievetext.operators.noise import complement_label, inject_noise
from sievetext.operators.order import with_ordinal
from sievetext.operators.selection import confident_rows, selection_or_none
from sievetext.operators.vocab import vocabulary, word_index


def test_empty_table_through_encode_and_ordinal(spark):
    empty = spark.createDataFrame([], "id long, text string")
    toks = empty.select("id", tokenize("text").alias("tokens"))
    idx = word_index(vocabulary(toks))
    assert {r.token for r in idx.collect()} == {"<PAD>", "<START>", "<END>", "<UNK>"}
    assert encode_fixed(toks, idx, 8).count() == 0
    assert with_ordinal(empty, ["id"]).count() == 0
    assert inject_noise(empty.select("id", F.lit(0).alias("label")), 3, 0.5).count() == 0


def test_null_and_empty_text(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "   ")], "id long, text string")
    toks = {r.id: r.t for r in df.select("id", tokenize("text").alias("t")).collect()}
    assert toks == {0: None, 1: [], 2: []}
    enc = {r.id: r.ids for r in encode_fixed(df.select("id", tokenize("text").alias("tokens")),
                                             word_index(vocabulary(df.select(F.array().cast("array<string>").alias("tokens")))), 5).collect()}
    assert enc[1] == [1, 2, 0, 0, 0] and enc[2] == [1, 2, 0, 0, 0] and enc[0] == [1, 2, 0, 0, 0]


def test_single_class(spark):
    df = spark.createDataFrame([(i, "x") for i in range(5)], "id long, label string")
    labels = collect_labels(df)
    assert labels == ["x"]
    coded = encode_labels(df, labels, code_col="y")
    out = inject_noise(coded.select("id", "y"), 1, 0.6, "inc", label_col="y").collect()
    assert all(r.y == 0 for r in out)
    with pytest.raises(ValueError):
        inject_noise(coded.select("id", "y"), 1, 0.6, "exc", label_col="y")
    with pytest.raises(ValueError):
        coded.select(complement_label("y", 1, 0))


@pytest.mark.parametrize("ratio,noisy", [(0.0, 0), (1.0, 20)])
def test_ratio_bounds(spark, ratio, noisy):
    df = spark.range(20).select("id", (F.col("id") % 4).cast("int").alias("label"))
    out = inject_noise(df, 4, ratio, "exc").collect()
    assert sum(r.is_noisy_row for r in out) == noisy
    assert sum(r.is_flipped for r in out) == noisy


def test_unknown_label_strict(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "zz")], "id long, label string")
    with pytest.raises(KeyError, match="zz"):
        encode_labels(df, ["a", "b"], code_col="y")
    assert encode_labels(df, ["a", "b"], code_col="y", strict=False).count() == 2


def test_empty_selection_and_loss(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5], 0), (1, [0.9, 0.1], 1)], "id long, probs array<double>, y int")
    assert selection_or_none(df, 0.95) is None
    assert confident_rows(df, 0.95).count() == 0
    rows = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, loss double")
    r = epoch_loss(rows, "loss", 4, order_by=["id"]).first()
    # batches {0..3} {4..7} {8,9}: means 1.5, 5.5, 8.5 -> reported 15.5 / 10
    assert r.n_rows == 10 and r.loss_mean == 4.5 and r.loss_reported == 1.55


def test_gradient_on_empty_selection(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0)], "id long, features array<double>, y int")
    g = gradient(df, SoftmaxHead(np.zeros((2, 2))), kind="pl", threshold=0.99)
    assert g["n"] == 0
    assert score(df.limit(0), SoftmaxHead(np.zeros((2, 2)))).count() == 0


def test_many_classes_use_the_join_path(spark):
    df = spark.range(500).select("id", (F.col("id") % 100).cast("string").alias("label"))
    labels = collect_labels(df)
    assert len(labels) == 100
    out = {r.id: r.y for r in encode_labels(df, labels, code_col="y").collect()}
    assert all(out[i] == labels.index(str(i % 100)) for i in range(500))
    with pytest.raises(KeyError):
        encode_labels(df, labels[:-1], code_col="y")


def test_json_array_file_and_csv_quotes(spark):
    import os

    from sievetext.session import scratch_path
    from sievetext.sources.files import read_csv, read_json, write_csv

    root = scratch_path(spark, "json-array")
    local = root[len("file:"):] if root.startswith("file:") else root
    os.makedirs(local, exist_ok=True)
    with open(os.path.join(local, "preds.json"), "w") as f:
        f.write('[{"id": 1, "actual_label": 2, "predicted_label": 2},\n'
                ' {"id": 2, "actual_label": 0, "predicted_label": 1}]')
    got = sorted(tuple(r) for r in read_json(spark, root, multi_line=True).collect())
    assert got == [(1, 2, 2), (2, 0, 1)]
    rows = [("a", 'say "hi",\nthen go'), ("b", "")]
    path = write_csv(spark.createDataFrame(rows, "label string, text string"), scratch_path(spark, "csvq"))
    back = sorted((r.label, r.text) for r in read_csv(spark, path).collect())
    assert back == sorted(rows)


def test_missing_labels_are_counted_and_named(spark):
    from sievetext.operators.labels import encode_labels

    rows = [("a",)] * 3 + [("x",)] * 2 + [(f"m{i:02d}",) for i in range(30)] + [(None,)]
    with pytest.raises(KeyError) as told:
        encode_labels(spark.createDataFrame(rows, "label string"), ["a"])
    assert "33 rows" in str(told.value) and "'x'" in str(told.value) and "m29" not in str(told.value)
