"""Mini-batch training passes as local SGD (W2 with G1, G2).

One optimiser step per 512 rows is the reference's way to train.  A Spark job
per step would not scale, so the rows are dealt over *shards* of a bounded
number of rows by a keyed draw; a pass walks every shard in keyed batches inside
one task, with an optimiser of its own, and the weights of all shards are
averaged by their row counts.  One pass is one job.

Shards are laid out once, a shard a written row (ids, labels and features as
binary): a pass scans them without a shuffle, and its result depends on the
ids and the seed only, not on partitions or task order (but for the last bits
of the floating-point average).  Draws are keyed by the pass, so every pass has
batches of its own.  The selection of a stage is made with the weights at the
start of the pass, before the rows are dealt over batches, as the reference
selects before its loader.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw_mod, py_draw
from ..operators.model import ROLE_GRAD_SCHEMA, SEEN, SoftmaxHead, _sums, fan_in, list_column, matrix, softmax_np, tree_sum
from ..session import scratch_path
from .train import GRAD_CLIP_PL, REFERENCE_LR, Adam, clip_by_norm

BATCH_SIZE = 512        # fixed value of the reference runner
#: Bytes of features in a shard, and rows at most.
SHARD_BYTES = 16 << 20
SHARD_ROWS = 65_536


def shard_count(n_rows: int, dim: int, shard_rows: int | None = None) -> int:
    """Shards of about ``shard_rows`` rows (by default what fits the bounds above)."""
    rows = shard_rows or min(SHARD_ROWS, max(1, SHARD_BYTES // (8 * dim)))
    return max(1, -(-n_rows // rows))


def pack_shards(df: DataFrame, dim: int, shards: int, seed: int = 7, id_col: str = "id", y_col: str = "y",
                features_col: str = "features") -> DataFrame:
    """Written rows ``(shard, n, ids, y, features)`` of ``df``, each shard sorted by id."""
    keyed = df.select(draw_mod(seed, "shard", shards, id_col).alias("shard"), F.col(id_col).cast("long").alias("id"),
                      F.col(y_col).cast("long").alias("y"), F.col(features_col).alias("features"))

    def row(shard, parts):
        ids, y, X = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((y, ids))
        return pa.RecordBatch.from_arrays(
            [pa.array([shard]), pa.array([len(ids)]), *[pa.array([np.ascontiguousarray(v[order]).tobytes()], pa.binary())
                                                        for v in (ids, y, X)]], ["shard", "n", "ids", "y", "features"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for rb in batches:
            if not rb.num_rows:
                continue
            shard = rb.column("shard").to_numpy()
            ids, y, X = rb.column("id").to_numpy(), rb.column("y").to_numpy(), matrix(rb.column("features"), dim)
            bounds = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if parts and shard[a] != now:
                    yield row(now, parts)
                    parts = []
                now = int(shard[a])
                parts.append((ids[a:b], y[a:b], X[a:b]))
        if parts:
            yield row(now, parts)

    path = scratch_path(df.sparkSession, "shards")
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (keyed.repartition(min(shards, max(conf, shards // 4)), "shard").sortWithinPartitions("shard")
     .mapInArrow(run, "shard bigint, n bigint, ids binary, y binary, features binary").write.parquet(path))
    return df.sparkSession.read.parquet(path)


def _walk(model: SoftmaxHead, kind: str, epoch: int, batch_size: int, lr: float, threshold: float | None,
          form: str, max_norm: float | None, seed: int):
    """Partial sums of a task's shards: rows, losses, and rows x weights after
    each shard's walk, with the sum of batch means and the steps behind them."""
    c, d = model.num_classes, model.dim

    def order(ids: np.ndarray) -> np.ndarray:
        keys = np.array([hashlib.md5(f"{seed}:batch:{epoch}:{i}".encode()).digest() for i in ids.tolist()], "S16")
        return np.lexsort((ids, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for shard in rb.to_pylist():
                ids, y = np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["y"], np.int64)
                X = np.frombuffer(shard["features"]).reshape(len(ids), d)
                turn = order(ids)
                if threshold is not None:
                    turn = turn[softmax_np(X[turn] @ model.W.T + model.b)[np.arange(len(turn)), y[turn]] > threshold]
                k = None
                if kind == "nl":
                    drawn = np.array([py_draw(seed, "comp", epoch, i) for i in ids.tolist()])
                    k = (y + 1 + drawn % (c - 1)) % c
                now, adam = model, Adam(lr=lr)
                loss = aux = means = 0.0
                steps = 0
                for a in range(0, len(turn), batch_size):
                    own = turn[a:a + batch_size]
                    n, own_loss, own_aux, G, _ = _sums(kind, X[own], y[own], None if k is None else k[own],
                                                    now.W, now.b, d, form, None)
                    grad, _ = clip_by_norm(G.ravel() / n, max_norm)
                    now = SoftmaxHead.from_flat(adam.step(now.flat(), grad), c, d)
                    loss, aux, means, steps = loss + own_loss, aux + own_aux, means + own_loss / n, steps + 1
                n = len(turn)  # the selected rows
                sums = np.concatenate([now.flat() * n, [means, steps]])
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n]), pa.array([loss]), pa.array([aux]),
                                                  list_column(sums[None]), pa.array([len(ids)]), pa.array([0])],
                                                 ["role", "n", "loss", "aux_loss", "grad", *SEEN])

    return run


def minibatch_pass(shards: DataFrame, model: SoftmaxHead, kind: str = "nl", epoch: int = 1,
                   batch_size: int = BATCH_SIZE, lr: float = REFERENCE_LR, threshold: float | None = None,
                   form: str = "complement", clip: float | None = "auto", seed: int = 7) -> tuple[SoftmaxHead, dict]:
    """One pass over packed shards; the averaged model and the pass's log row.
    ``reported_loss`` is what the reference prints: the batch means' sum over
    the number of rows (Q11)."""
    if kind not in ("nl", "pl"):
        raise ValueError("kind must be 'nl' or 'pl'")
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    max_norm = (GRAD_CLIP_PL if kind == "pl" else None) if clip == "auto" else clip
    parts = shards.mapInArrow(_walk(model, kind, epoch, batch_size, lr, threshold, form, max_norm, seed),
                              ROLE_GRAD_SCHEMA)
    row = tree_sum(parts, fan_in(shards), "role").first()  # none without shards
    n = int(row["n"]) if row else 0
    if n == 0:
        return model, {"n_rows": 0, "stopped": True}
    sums = np.asarray(row["grad"])
    return SoftmaxHead.from_flat(sums[:-2] / n, model.num_classes, model.dim), {
        "n_rows": n, "train_loss": row["loss"] / n,
        "train_pos_loss": (row["aux_loss"] if kind == "nl" else row["loss"]) / n,
        "reported_loss": float(sums[-2]) / n, "batches": int(round(sums[-1])), "stopped": False}


def train_minibatch(train: DataFrame, num_classes: int, dim: int, epochs: int, kind: str = "nl",
                    select: str | None = None, gamma: float = 0.5, batch_size: int = BATCH_SIZE,
                    lr: float = REFERENCE_LR, shard_rows: int | None = None, model: SoftmaxHead | None = None,
                    form: str = "complement", clip: float | None = "auto", seed: int = 7, id_col: str = "id",
                    shards: DataFrame | None = None, history: list | None = None) -> tuple[SoftmaxHead, list]:
    """``epochs`` passes of local SGD over ``id, y, features`` rows: the model and
    the log, a row per pass.  An empty selection stops the stage.  ``shards``:
    the packed rows of an earlier stage."""
    threshold = None if select is None else {"selnl": 1.0 / num_classes, "selpl": float(gamma)}[select]
    if shards is None:
        shards = pack_shards(train, dim, shard_count(train.count(), dim, shard_rows), seed, id_col)
    model, history = model or SoftmaxHead.zeros(num_classes, dim), history if history is not None else []
    for epoch in range(1, epochs + 1):
        began = time.time()
        model, row = minibatch_pass(shards, model, kind, len(history) + 1, batch_size, lr, threshold, form, clip, seed)
        history.append({"step": len(history) + 1, "stage": select or kind, "epoch": epoch, **row,
                        "seconds": time.time() - began})
        if row["stopped"]:
            break
    return model, history
