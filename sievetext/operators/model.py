"""Data-parallel scoring and gradients of the classifier head.

Scoring and gradient passes run as ``mapInArrow`` over Arrow record batches:
the feature column arrives as one contiguous float64 buffer, NumPy does the
matrix products, and each partition sends back either scored rows or a
single row of partial sums.  The partial sums are added in two levels by the JVM
vector aggregate (``Summarizer.sum``), so no task meets one row of every
partition.
Only model-sized data (c x (d+1) numbers) ever reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vecmath import PROB_FLOOR
from ..session import input_partitions
from .exact import PLANES, carried, exact_products, exact_total, row_products, rounded, zero_sums


@dataclass
class SoftmaxHead:
    """``p = softmax(W x + b)``; W is c x d."""
    W: np.ndarray
    b: np.ndarray = field(default=None)

    def __post_init__(self):
        self.W = np.asarray(self.W, dtype=np.float64)
        if self.b is None:
            self.b = np.zeros(self.W.shape[0])
        self.b = np.asarray(self.b, dtype=np.float64)

    @property
    def num_classes(self) -> int:
        return self.W.shape[0]

    @property
    def dim(self) -> int:
        return self.W.shape[1]

    @classmethod
    def zeros(cls, num_classes: int, dim: int) -> "SoftmaxHead":
        return cls(np.zeros((num_classes, dim)), np.zeros(num_classes))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.W, self.b[:, None]], axis=1).ravel()

    @classmethod
    def from_flat(cls, flat: np.ndarray, num_classes: int, dim: int) -> "SoftmaxHead":
        m = np.asarray(flat, dtype=np.float64).reshape(num_classes, dim + 1)
        return cls(m[:, :dim].copy(), m[:, dim].copy())

    def logits(self, X: np.ndarray) -> np.ndarray:
        return X @ self.W.T + self.b

    def probs(self, X: np.ndarray) -> np.ndarray:
        return softmax_np(self.logits(X))


def softmax_np(Z: np.ndarray) -> np.ndarray:
    Z = Z - Z.max(axis=1, keepdims=True)
    E = np.exp(Z)
    return E / E.sum(axis=1, keepdims=True)


# ---------------------------------------------------------------- Arrow helpers

def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A list<double> Arrow column of fixed length ``dim`` as an n x dim matrix."""
    n = len(col)
    if n == 0:
        return np.zeros((0, dim))
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if values.size != n * dim:
        raise ValueError(f"feature vectors must all have length {dim}")
    return values.reshape(n, dim)


def list_column(M: np.ndarray) -> pa.Array:
    n, c = M.shape
    offsets = pa.array(np.arange(0, (n + 1) * c, c, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(M.ravel(), type=pa.float64()))


# ---------------------------------------------------------------- scoring

def score(df: DataFrame, model: SoftmaxHead, features_col: str = "features",
          out_col: str = "probs", log: bool = False, drop_features: bool = True,
          raw: bool = False) -> DataFrame:
    """Add class probabilities (log-probabilities with ``log``, the linear
    layer's outputs with ``raw``) as ``array<double>``."""
    W, b, d = model.W, model.b, model.dim
    fields = [f for f in df.schema.fields if not (drop_features and f.name == features_col)]
    schema = T.StructType(fields + [T.StructField(out_col, T.ArrayType(T.DoubleType()), False)])
    names = [f.name for f in fields]

    def run(batches):
        for rb in batches:
            X = matrix(rb.column(features_col), d)
            Z = X @ W.T + b
            Z = Z - Z.max(axis=1, keepdims=True) if len(Z) and not raw else Z
            if raw:
                P = Z
            elif log:
                P = Z - np.log(np.exp(Z).sum(axis=1, keepdims=True)) if len(Z) else Z
            else:
                E = np.exp(Z)
                P = E / E.sum(axis=1, keepdims=True) if len(Z) else Z
            cols = [rb.column(n) for n in names] + [list_column(P.reshape(len(X), W.shape[0]))]
            yield pa.RecordBatch.from_arrays(cols, names=names + [out_col])

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- gradients

GRAD_SCHEMA = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("loss", T.DoubleType()),
    T.StructField("aux_loss", T.DoubleType()),
    T.StructField("grad", T.ArrayType(T.DoubleType())),
])
#: Rows met and rows whose arg-max class is the label, for the log of the pass.
SEEN = ("seen", "correct")
SEEN_GRAD_SCHEMA = T.StructType(GRAD_SCHEMA.fields + [T.StructField(c, T.LongType()) for c in SEEN])
ROLE_GRAD_SCHEMA = T.StructType([T.StructField("role", T.IntegerType())] + SEEN_GRAD_SCHEMA.fields)


def _terms(kind, X, y, k, Z, form, threshold):
    """What the rows of one batch add to the sums, from their logits: features,
    derivatives by the logits, losses and positive losses (``None`` for ``pl``) of
    the rows that take part, and how many of all rows have their label as arg-max
    class (the first of equal ones)."""
    P = softmax_np(Z)
    rows = np.arange(len(y))
    correct = int((P.argmax(axis=1) == y).sum()) if len(y) else 0
    if threshold is not None:
        keep = P[rows, y] > threshold
        X, y, P = X[keep], y[keep], P[keep]
        k = k[keep] if k is not None else None
        rows = np.arange(len(y))
    py = np.maximum(P[rows, y], PROB_FLOOR)
    aux = None
    if kind == "pl":
        dZ = P.copy()
        dZ[rows, y] -= 1.0
        loss = -np.log(py)
    else:
        pk = P[rows, k]
        onek = np.zeros_like(P)
        onek[rows, k] = 1.0
        if form == "complement":
            q = np.maximum(1.0 - pk, PROB_FLOOR)
            dZ = (pk / q)[:, None] * (onek - P)
            loss = -np.log(q)
        else:  # as_written: log p_k - 1
            dZ = onek - P
            loss = np.log(np.maximum(pk, PROB_FLOOR)) - 1.0
        aux = -np.log(py)
    return X, dZ, loss, aux, correct


def _sums(kind, X, y, k, W, b, d, form, threshold):
    """Loss sums and gradient sums (c x (d+1)) of one batch, and the rows whose
    arg-max class is their label."""
    X, dZ, loss, aux, correct = _terms(kind, X, y, k, X @ W.T + b, form, threshold)
    G = np.zeros((W.shape[0], d + 1))
    if len(X) == 0:
        return 0, 0.0, 0.0, G, correct
    G[:, :d] = dZ.T @ X
    G[:, d] = dZ.sum(axis=0)
    return len(X), float(loss.sum()), 0.0 if aux is None else float(aux.sum()), G, correct


def _exact_sums(kind, X, y, k, W, b, d, form, threshold):
    """The same as digits of exact sums: loss, positive loss, gradient."""
    X, dZ, loss, aux, correct = _terms(kind, X, y, k, row_products(X, W) + b, form, threshold)
    with_bias = np.hstack([X, np.ones((len(X), 1))])
    sums = [exact_total(loss), exact_total(loss[:0] if aux is None else aux), exact_products(dZ, with_bias)]
    return len(X), np.hstack([s.reshape(PLANES, -1) for s in sums]), correct


def _partial(kind, W, b, d, form, threshold, features_col, y_col, comp_col, role_col=None):
    """Per-partition sums; with ``role_col`` one row per role (0 = trained
    rows, selection applies; others = evaluated rows, all count)."""

    def run(batches):
        acc = {}
        for rb in batches:
            if rb.num_rows == 0:
                continue
            X = matrix(rb.column(features_col), d)
            y = rb.column(y_col).to_numpy(zero_copy_only=False).astype(np.int64)
            k = (rb.column(comp_col).to_numpy(zero_copy_only=False).astype(np.int64)
                 if comp_col else None)
            roles = (rb.column(role_col).to_numpy(zero_copy_only=False).astype(np.int64)
                     if role_col else np.zeros(len(y), np.int64))
            for r in np.unique(roles):
                m = roles == r
                got = _sums(kind, X[m], y[m], k[m] if k is not None else None, W, b, d, form,
                            threshold if r == 0 else None)
                a = acc.setdefault(int(r), [0, 0.0, 0.0, np.zeros((W.shape[0], d + 1)), 0, 0])
                for i, v in enumerate((*got[:4], int(m.sum()), got[4])):
                    a[i] = a[i] + v
        if not acc:
            acc[0] = [0, 0.0, 0.0, np.zeros((W.shape[0], d + 1)), 0, 0]
        rs = sorted(acc)
        cols = [pa.array([acc[r][0] for r in rs], pa.int64()), pa.array([acc[r][1] for r in rs]),
                pa.array([acc[r][2] for r in rs]),
                list_column(np.stack([acc[r][3].ravel() for r in rs])),
                *[pa.array([acc[r][i] for r in rs], pa.int64()) for i in (4, 5)]]
        names = ["n", "loss", "aux_loss", "grad", *SEEN]
        if role_col:
            cols, names = [pa.array(rs, pa.int32())] + cols, ["role"] + names
        yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _batches_by_role(batches, d, features_col, y_col, comp_col, role_col):
    """``(role, X, y, k)`` of every Arrow batch that has rows."""
    for rb in batches:
        if rb.num_rows == 0:
            continue
        X = matrix(rb.column(features_col), d)
        y, k, roles = (rb.column(c).to_numpy(zero_copy_only=False).astype(np.int64) if c else None
                       for c in (y_col, comp_col, role_col))
        for r in (np.unique(roles) if role_col else [0]):
            m = roles == r if role_col else slice(None)
            yield int(r), X[m], y[m], k[m] if comp_col else None


_EXACT_SCHEMA = ("role int, n bigint, seen bigint, correct bigint, sums array<bigint>")


def _exact_rows(acc: dict) -> pa.RecordBatch:
    """Counts and digits per role as rows of :data:`_EXACT_SCHEMA`."""
    rs = sorted(acc)
    sums = pa.array([acc[r][1].ravel() for r in rs], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(rs, pa.int32()), *[pa.array([int(acc[r][0][i]) for r in rs], pa.int64()) for i in range(3)], sums],
        names=["role", "n", "seen", "correct", "sums"])


def _add_exact(acc: dict, role: int, counts, sums: np.ndarray):
    if role in acc:
        counts, sums = acc[role][0] + counts, carried(acc[role][1] + sums)
    acc[role] = (np.asarray(counts, np.int64), sums)


def _partial_exact(kind, W, b, d, form, threshold, features_col, y_col, comp_col, role_col=None):
    """Per-partition digits of exact sums, one row per role."""

    def run(batches):
        acc = {0: (np.zeros(3, np.int64), zero_sums((2 + W.shape[0] * (d + 1),)))}
        for role, X, y, k in _batches_by_role(batches, d, features_col, y_col, comp_col, role_col):
            n, sums, correct = _exact_sums(kind, X, y, k, W, b, d, form, threshold if role == 0 else None)
            _add_exact(acc, role, [n, len(y), correct], sums)
        yield _exact_rows(acc)

    return run


def _exact_total_frame(parts: DataFrame, groups: int, with_role: bool) -> DataFrame:
    """Digits of all partitions added in two levels, then rounded once."""

    def added(batches):
        acc: dict = {}
        for rb in batches:
            for row in zip(*[rb.column(c).to_pylist() for c in ("role", "n", "seen", "correct")],
                           rb.column("sums"), strict=True):
                sums = row[4].values.to_numpy(zero_copy_only=False).astype(np.int64)
                _add_exact(acc, row[0], row[1:4], sums.reshape(PLANES, -1))
        return acc

    def merge(batches):
        acc = added(batches)
        if acc:
            yield _exact_rows(acc)

    def finish(batches):
        acc = added(batches)
        rs = sorted(acc)
        done = [rounded(acc[r][1]) for r in rs]
        n, seen, correct = (pa.array([int(acc[r][0][i]) for r in rs], pa.int64()) for i in range(3))
        cols = [n, pa.array([v[0] for v in done], pa.float64()), pa.array([v[1] for v in done], pa.float64()),
                pa.array([v[2:] for v in done], pa.list_(pa.float64())), seen, correct]
        names = ["n", "loss", "aux_loss", "grad", *SEEN]
        if with_role:
            cols, names = [pa.array(rs, pa.int32()), *cols], ["role", *names]
        yield pa.RecordBatch.from_arrays(cols, names=names)

    grouped = parts.repartition(groups, F.pmod(F.spark_partition_id(), F.lit(groups))).mapInArrow(merge, _EXACT_SCHEMA)
    return grouped.repartition(1).mapInArrow(finish, ROLE_GRAD_SCHEMA if with_role else SEEN_GRAD_SCHEMA)


def gradient_frame(df: DataFrame, model: SoftmaxHead, kind: str = "pl",
                   form: str = "complement", threshold: float | None = None,
                   features_col: str = "features", y_col: str = "y",
                   comp_col: str | None = None, role_col: str | None = None,
                   exact: bool = False) -> DataFrame:
    """Sums over the rows of ``df``: ``n, loss, aux_loss, grad, seen, correct`` (one
    row, or one row per role with ``role_col``).

    ``kind='pl'``: NLL of ``y``.  ``kind='nl'``: loss of the complementary label
    in ``comp_col`` (``form`` as in Q1); ``aux_loss`` is the positive loss
    tracked beside it.  With ``threshold`` only rows whose current ``p[y]`` is
    strictly above it take part (the SelNL / SelPL selection, made with the
    same weights in the same pass); with ``role_col`` the selection applies
    to role 0 only, so a training set and an evaluation set share one scan.
    ``grad`` is c x (d+1) row-major, the last column for the bias; divide by
    ``n`` for the mean.

    ``exact`` adds without rounding (:mod:`.exact`): the sums are the same bit
    for bit however the rows are partitioned, ordered and batched.
    """
    if kind not in ("pl", "nl"):
        raise ValueError("kind must be 'pl' or 'nl'")
    if kind == "nl" and not comp_col:
        raise ValueError("nl needs comp_col")
    cols = [features_col, y_col] + ([comp_col] if comp_col else []) + ([role_col] if role_col else [])
    make = _partial_exact if exact else _partial
    run = make(kind, model.W, model.b, model.dim, form, threshold, features_col, y_col,
               comp_col if kind == "nl" else None, role_col)
    if exact:
        return _exact_total_frame(df.select(*cols).mapInArrow(run, _EXACT_SCHEMA), fan_in(df), bool(role_col))
    parts = df.select(*cols).mapInArrow(run, ROLE_GRAD_SCHEMA if role_col else SEEN_GRAD_SCHEMA)
    return tree_sum(parts, fan_in(df), "role" if role_col else None)


def fan_in(df: DataFrame) -> int:
    """Groups of the first level of :func:`tree_sum`: about the square root of
    the number of partitions, so neither level meets more than that in a task."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, math.isqrt(max(conf, input_partitions(df) or 0)))


def tree_sum(parts: DataFrame, groups: int, by: str | None = None) -> DataFrame:
    """Sums of per-partition rows in two levels: first within ``groups`` groups
    of partitions, then over the groups."""
    counts = [c for c in SEEN if c in parts.columns]

    def sums():
        return [F.sum("n").alias("n"), F.sum("loss").alias("loss"), F.sum("aux_loss").alias("aux_loss"),
                vector_to_array(Summarizer.sum(array_to_vector("grad"))).alias("grad"),
                *[F.sum(c).alias(c) for c in counts]]

    keys = [by] if by else []
    first = parts.groupBy(*keys, F.pmod(F.spark_partition_id(), F.lit(groups)).alias("_group")).agg(*sums())
    return first.groupBy(by).agg(*sums()) if by else first.agg(*sums())


def _mean(row, model) -> dict:
    n = int(row["n"] or 0) if row is not None else 0
    counts = {c: int(row[c] or 0) if row is not None else 0 for c in SEEN}
    if n == 0:
        return {"n": 0, "loss": float("nan"), "aux_loss": float("nan"),
                "grad": np.zeros(model.num_classes * (model.dim + 1)), **counts}
    return {"n": n, "loss": row["loss"] / n, "aux_loss": row["aux_loss"] / n,
            "grad": np.asarray(row["grad"]) / n, **counts}


def gradients_by_role(df: DataFrame, model: SoftmaxHead, role_col: str = "_role", **kw) -> dict:
    """:func:`gradient_frame` per role in one job: ``{role: mean sums}``."""
    rows = gradient_frame(df, model, role_col=role_col, **kw).collect()
    return {int(r["role"]): _mean(r, model) for r in rows}


def gradient(df: DataFrame, model: SoftmaxHead, **kw) -> dict:
    """Run :func:`gradient_frame` and return mean loss and mean gradient."""
    return _mean(gradient_frame(df, model, **kw).first(), model)


def centroid_model(df: DataFrame, num_classes: int, dim: int, scale: float = 10.0,
                   features_col: str = "features", y_col: str = "y") -> SoftmaxHead:
    """Weights = ``scale`` x class centroids, no bias: fixed, data-derived
    weights for checking scores, losses and gradients."""
    rows = (df.groupBy(y_col).agg(vector_to_array(Summarizer.mean(array_to_vector(features_col)))
                                  .alias("m")).collect())
    if len(rows) > num_classes:
        raise ValueError("more classes than num_classes")
    W = np.zeros((num_classes, dim))
    for r in rows:
        W[int(r[y_col])] = np.asarray(r["m"]) * scale
    return SoftmaxHead(W)
