"""Vector tables that go through the driver."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievetext.operators.cnn import CNNRunner, CNNText
from sievetext.operators.frequent import collected_rows
from sievetext.operators.vectors import mean_pool

VECTORS = {0: [0.0, 0.0], 1: [0.5, -2.0], 2: [0.1, 1 / 3], 4: None, 5: [3.0, 4.0]}


@pytest.fixture
def lookup(spark):
    return spark.createDataFrame([(i, v) for i, v in VECTORS.items()], "id long, vec array<double>")


@pytest.mark.parametrize("per_batch", [2, 1000])
@pytest.mark.parametrize("by_key", [False, True])
def test_collected_rows_are_the_tables(spark, lookup, per_batch, by_key):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    try:
        keys, M = collected_rows(lookup.repartition(3), "id", 2, np.array([7.0, 8.0]), by_key)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(keys.to_pylist()) == sorted(VECTORS)
    at = keys.to_pylist() if by_key else range(len(keys))
    for row, key in zip(at, keys.to_pylist(), strict=True):
        assert M.take(np.array([row]))[0].tolist() == (VECTORS[key] or [7.0, 8.0])
    assert M.take(np.array([-1]))[0].tolist() == [7.0, 8.0]
    if by_key:
        assert M.take(np.array([3]))[0].tolist() == [0.0, 0.0]


def test_collected_rows_of_an_empty_table(lookup):
    for by_key in (False, True):
        keys, M = collected_rows(lookup.where("id < 0"), "id", 2, np.zeros(2), by_key)
        assert len(keys) == 0 and M.single.shape == (0, 2)


def test_no_vector_table_is_collected_in_one_piece(spark, lookup, monkeypatch):
    """cnn_gradient, train_cnn: the driver once held the frequent vectors as Arrow
    and as a matrix."""
    def whole(self):
        raise AssertionError("collected whole")

    monkeypatch.setattr(DataFrame, "toArrow", whole)
    enc = spark.createDataFrame([(1, 0, [1, 2, 5, 0, 0, 0]), (2, 1, [5, 5, 3, 0, 0, 0])], "id long, y int, ids array<long>")
    model = CNNText(2, 2)
    table = lookup.where("id <> 4")
    sums = [CNNRunner(enc, table, 2, 6, **kw).gradient_frame(model, epoch=3).first()["grad"]
            for kw in ({}, {"budget": 0, "hot": table.where("id < 2")})]
    assert np.allclose(sums[0], sums[1])
    texts = enc.select("id", F.col("ids").alias("tokens"))
    pooled = {r.id: r.features for r in mean_pool(texts, table, 2, key="id", method="local").collect()}
    assert np.allclose(pooled[2], [1.0, 8 / 6])
