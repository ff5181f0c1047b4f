"""Keyed draws, ordinals, noise and complementary labels (FIXTURES.md B)."""

import pytest
from pyspark.sql import functions as F

from sievetext.operators.noise import complement_label, generate_noise, inject_noise
from sievetext.operators.order import batches, exact_split, shuffled_ordinal, with_ordinal


def _ten(spark):
    return spark.createDataFrame([(i, i % 6) for i in range(10)], "id long, label int")


def test_shuffle_order_fixture(spark):
    got = shuffled_ordinal(_ten(spark)).orderBy("pos").collect()
    assert [r.id for r in got] == [3, 4, 0, 8, 6, 1, 2, 7, 9, 5]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_noise_fixture_and_partition_invariance(spark, parts):
    df = _ten(spark).repartition(parts)
    inc = {r.id: r for r in inject_noise(df, 6, 0.3, "inc", num_partitions=parts).collect()}
    exc = {r.id: r for r in inject_noise(df, 6, 0.3, "exc", num_partitions=parts).collect()}
    assert {i for i, r in inc.items() if r.is_noisy_row} == {5, 7, 9}
    assert {i: inc[i].label for i in (5, 7, 9)} == {5: 4, 7: 5, 9: 3}
    assert {i: exc[i].label for i in (5, 7, 9)} == {5: 1, 7: 5, 9: 1}
    assert all(r.label == r.label_clean for r in inc.values() if not r.is_noisy_row)
    assert sum(r.is_flipped for r in exc.values()) == 3


def test_noise_truncation_and_errors(spark):
    out = inject_noise(_ten(spark), 6, 0.9, "exc").collect()
    assert sum(r.is_noisy_row for r in out) == 10  # int(0.1 * 10) == 0 clean rows
    assert sum(r.is_noisy_row for r in inject_noise(_ten(spark), 6, 0.0).collect()) == 0
    with pytest.raises(ValueError):
        generate_noise(_ten(spark), "bogus")
    with pytest.raises(ValueError):
        inject_noise(_ten(spark), 1, 0.5, "exc")


def test_complement_fixture(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(6)], "id long, y int")
    for epoch, want in ((0, [1, 3, 1, 1, 2, 3]), (1, [3, 3, 0, 1, 1, 2])):
        got = df.select("id", complement_label("y", 4, epoch).alias("c")).orderBy("id").collect()
        assert [r.c for r in got] == want


def test_complement_never_equals_label(spark):
    df = spark.range(2000).select("id", (F.col("id") % 5).cast("int").alias("y"))
    bad = df.where(complement_label("y", 5, 3) == F.col("y")).count()
    assert bad == 0


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_ordinal_dense_and_ordered(spark, parts):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("k"), "id")
    rows = with_ordinal(df, ["k", "id"], num_partitions=parts).collect()
    assert sorted(r.pos for r in rows) == list(range(5000))
    by_pos = [(r.k, r.id) for r in sorted(rows, key=lambda r: r.pos)]
    assert by_pos == sorted(by_pos)


@pytest.mark.parametrize("n,parts", [(20_000, 1), (20_000, 3), (20_000, 8), (1_000_000, 8)])
def test_ordinal_of_wide_rows(spark, n, parts):
    """Rows wider than their sort keys: every position occurs once, in order."""
    df = spark.range(0, n, 1, 7).select((F.col("id") * 7919 % 5003).alias("k"), "id",
                                        F.md5(F.col("id").cast("string")).alias("payload"))
    out = with_ordinal(df, ["k", "id"], num_partitions=parts, total="n").cache()
    want = spark.range(n).withColumnRenamed("id", "pos")
    assert out.join(want, "pos").count() == n and out.select("pos").distinct().count() == n
    assert out.where(F.col("n") != n).isEmpty()
    assert out.where(F.md5(F.col("id").cast("string")) != F.col("payload")).isEmpty()
    before = out.select((F.col("pos") + 1).alias("pos"), F.struct("k", "id").alias("before"))
    assert out.join(before, "pos").where(F.col("before") >= F.struct("k", "id")).isEmpty()
    out.unpersist()


def test_wide_batches_are_full(spark):
    df = spark.range(0, 200_000, 1, 5).withColumn("payload", F.sha2(F.col("id").cast("string"), 256))
    sizes = batches(df, 64, num_partitions=8).groupBy("batch_id").count().select("count").distinct().collect()
    assert [r[0] for r in sizes] == [64]


def test_batches_and_split(spark):
    df = spark.range(130)
    b = batches(df, 64, drop_last=True).collect()
    assert len(b) == 128 and max(r.batch_id for r in b) == 1
    s = exact_split(df, 0.2).collect()
    assert sum(r.is_valid for r in s) == 26
