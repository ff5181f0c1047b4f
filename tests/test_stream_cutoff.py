"""The stream of language-model batches, exact cut-offs, running totals."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from sievetext.functions.draws import shuffle_key
from sievetext.operators import order
from sievetext.operators.lm import stream_batches, stream_windows
from sievetext.operators.noise import inject_noise
from sievetext.operators.order import exact_split, key_at, running_total


@pytest.mark.parametrize("seed,bs,window", [(1, 3, 4), (2, 48, 70), (3, 1, 5), (4, 7, 1000), (5, 5, 1)])
def test_stream_equals_plain_cutting(spark, seed, bs, window):
    rng = random.Random(seed)
    texts = [(i, [f"t{i}_{k}" for k in range(rng.choice([0, 1, 2, 9, 40]))]) for i in range(rng.randint(1, 60))]
    texts += [(1000, ["long"] * 300), (1001, None), (1002, [])]
    stream = [t for _, ts in sorted(texts) for t in ts or []]
    length = -(-(len(stream) - 1) // bs)
    want = sorted(((g % length) // window, g // length, g % length % window, stream[g], stream[g + 1])
                  for g in range(len(stream) - 1))
    df = spark.createDataFrame(texts, "id long, tokens array<string>").repartition(4)
    assert sorted(map(tuple, stream_batches(df, bs, window).collect())) == want
    pieces = stream_windows(df, bs, window).collect()
    assert all(0 < len(p.tokens) == len(p.targets) <= window for p in pieces)


def test_stream_of_nothing_and_of_one_token(spark):
    for texts in ([], [(1, None)], [(1, ["only"])]):
        df = spark.createDataFrame(texts, "id long, tokens array<string>")
        assert stream_batches(df, 48, 70).collect() == []
    with pytest.raises(ValueError):
        stream_batches(df, 0)


def test_running_total(spark):
    rows = [(i, (i * 7) % 5) for i in range(500)]
    got = running_total(spark.createDataFrame(rows, "id long, n long").repartition(6), ["id"], "n", num_partitions=9)
    want, before = {}, 0
    for i, n in rows:
        want[i] = before
        before += n
    assert {r.id: r.before for r in got.collect()} == want and {r.total for r in got.collect()} == {before}


@pytest.mark.parametrize("small", [0, 1, 3, 65_536])
def test_key_at_equals_sorting(spark, monkeypatch, small):
    monkeypatch.setattr(order, "SMALL_BIN", max(small, 2))
    ids = list(range(300)) + [7, 7, 9]  # repeated ids share a digest
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)
    keys = sorted((hashlib.md5(f"7:shuffle:{i}".encode()).hexdigest(), i) for i in ids)
    for place in (0, 1, 150, len(ids) - 1):
        assert key_at(df, shuffle_key(7, "shuffle", "id"), "id", lambda n: place) == (len(ids), *keys[place])
    assert key_at(df, shuffle_key(7, "shuffle", "id"), "id", lambda n: n) == (len(ids), None, None)


def test_flags_equal_positions_and_nothing_moves(spark):
    df = spark.range(997).withColumn("label", (F.col("id") % 4).cast("int"))
    for share in (0.0, 0.2, 0.5, 1.0):
        a = exact_split(df, share).select("id", "is_valid").collect()
        lazy = exact_split(df, share, with_position=False)
        assert sorted(map(tuple, a)) == sorted(map(tuple, lazy.select("id", "is_valid").collect()))
        assert "Exchange" not in lazy._jdf.queryExecution().executedPlan().toString()
        a = inject_noise(df, 4, share, with_position=True).select("id", "label", "is_noisy_row").collect()
        lazy = inject_noise(df, 4, share)
        assert sorted(map(tuple, a)) == sorted(map(tuple, lazy.select("id", "label", "is_noisy_row").collect()))
        assert "Exchange" not in lazy._jdf.queryExecution().executedPlan().toString()


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, label int")
    assert exact_split(df, 0.5, with_position=False).collect() == [] == inject_noise(df, 3, 0.3).collect()
