"""Mini-batch passes against a plain loop over the same keyed batches."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from sievetext.functions.draws import py_draw
from sievetext.operators.model import SoftmaxHead, softmax_np
from sievetext.plans.minibatch import minibatch_pass, pack_shards, shard_count, train_minibatch
from sievetext.plans.train import Adam

C, D = 3, 4


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    y = rng.integers(0, C, 400)
    X = rng.normal(size=(400, D)) + 2 * np.eye(C, D)[y]
    return [(i, int(k), x.tolist()) for i, (k, x) in enumerate(zip(y, X))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, y int, features array<double>")


def plain_pass(rows, model, shards, kind, epoch, batch, lr, threshold=None, clip=None):
    """The same pass in plain Python; returns flat weights and rows."""
    total, count = np.zeros(C * (D + 1)), 0
    for s in range(shards):
        own = sorted((hashlib.md5(f"7:batch:{epoch}:{i}".encode()).digest(), i, y, x) for i, y, x in rows
                     if py_draw(7, "shard", i) % shards == s)
        if threshold is not None:
            own = [r for r in own if softmax_np(np.array([r[3]]) @ model.W.T + model.b)[0, r[2]] > threshold]
        w, adam = model, Adam(lr=lr)
        for a in range(0, len(own), batch):
            grad = np.zeros((C, D + 1))
            for _, i, y, x in own[a:a + batch]:
                p = softmax_np(np.array([x]) @ w.W.T + w.b)[0]
                if kind == "pl":
                    dz = p - np.eye(C)[y]
                else:
                    k = (y + 1 + py_draw(7, "comp", epoch, i) % (C - 1)) % C
                    dz = p[k] / (1 - p[k]) * (np.eye(C)[k] - p)
                grad += np.outer(dz, [*x, 1.0])
            grad = grad.ravel() / len(own[a:a + batch])
            norm = np.linalg.norm(grad)
            if clip and norm > clip:
                grad *= clip / (norm + 1e-6)
            w = SoftmaxHead.from_flat(adam.step(w.flat(), grad), C, D)
        total, count = total + len(own) * w.flat(), count + len(own)
    return total / count, count


@pytest.mark.parametrize("kind,threshold,clip", [("nl", None, None), ("pl", None, 0.2), ("pl", 0.5, None)])
def test_pass_equals_plain_loop(spark, rows, kind, threshold, clip):
    start = SoftmaxHead(np.eye(C, D) * 0.3, np.array([0.1, 0.0, -0.1]))
    shards = pack_shards(frame(spark, rows), D, 5)
    got, log = minibatch_pass(shards, start, kind, 2, 16, 0.05, threshold, clip=clip)
    want, n = plain_pass(rows, start, 5, kind, 2, 16, 0.05, threshold, clip)
    assert log["n_rows"] == n and np.allclose(got.flat(), want, atol=1e-12)
    assert log["batches"] >= -(-n // 16)


def test_partitions_change_nothing(spark, rows):
    done = []
    for parts in (1, 8):
        df = frame(spark, rows).repartition(parts)
        model, log = train_minibatch(df, C, D, 3, "nl", batch_size=32, lr=0.05, shard_rows=90)
        done.append((model.flat(), [(r["n_rows"], r["batches"]) for r in log], [r["train_loss"] for r in log]))
    assert done[0][1] == done[1][1]
    assert np.allclose(done[0][0], done[1][0], atol=1e-12) and np.allclose(done[0][2], done[1][2], atol=1e-12)


def test_learns_and_stops_on_an_empty_selection(spark, rows):
    df = frame(spark, rows)
    model, log = train_minibatch(df, C, D, 6, "pl", batch_size=32, lr=0.05, shard_rows=200)
    assert log[-1]["train_loss"] < 0.5 * log[0]["train_loss"]
    model, log = train_minibatch(df, C, D, 6, "pl", "selpl", gamma=1.0, model=model, history=log)
    assert len(log) == 7 and log[-1]["stopped"] and log[-1]["n_rows"] == 0
    model, log = train_minibatch(df.where("id < 0"), C, D, 2)
    assert log[0]["stopped"] and not model.flat().any()


def test_one_row_a_shard_and_no_shuffle_in_a_pass(spark, rows):
    df = frame(spark, rows)
    shards = pack_shards(df, D, shard_count(400, D, 60))
    assert shards.count() == shards.select("shard").distinct().count() <= 7
    assert shards.agg(F.sum("n")).first()[0] == 400
    assert shard_count(0, D) == 1 and shard_count(10**9, 300) == -(-10**9 // ((16 << 20) // 2400))
    assert "Exchange" not in shards._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        minibatch_pass(shards, SoftmaxHead.zeros(C, D), "other")
