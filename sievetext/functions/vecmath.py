"""Array arithmetic as Column expressions.

Everything here is a JVM expression over ``array<double>`` columns, so it
needs no Python worker.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values --------------------------------------------------------
PROB_FLOOR = 1e-12     # floor of p and 1 - p before a log (NL near p -> 1)
# --------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def linear(x, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """``W x + b`` with literal weights (M4): one dot product per class."""
    out = []
    for k, row in enumerate(weights):
        z = dot(x, F.array(*[F.lit(float(v)) for v in row]))
        if bias is not None:
            z = z + F.lit(float(bias[k]))
        out.append(z)
    return F.array(*out)


def relu(x) -> Column:
    return F.transform(_c(x), lambda v: F.greatest(v, F.lit(0.0)))


def log_softmax(z) -> Column:
    """``z - max - log(sum(exp(z - max)))`` (M1)."""
    z = _c(z)
    m = F.array_max(z)
    lse = F.log(F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - m)))
    return F.transform(z, lambda v: v - m - lse)


def softmax(z) -> Column:
    z = _c(z)
    m = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - m))
    return F.transform(z, lambda v: F.exp(v - m) / total)


def complement(p) -> Column:
    """``1 - p`` per class (M2)."""
    return F.transform(_c(p), lambda v: F.lit(1.0) - v)


def pick(p, k) -> Column:
    """``p[k]`` for a 0-based class column (J6: no B x B gather)."""
    return F.element_at(_c(p), _c(k).cast("int") + F.lit(1))


def argmax(p) -> Column:
    """0-based index of the largest value, first one on ties."""
    p = _c(p)
    return (F.array_position(p, F.array_max(p)) - F.lit(1)).cast("int")


def nll(p, y) -> Column:
    """``-log p[y]`` with p floored (M3)."""
    return -F.log(F.greatest(pick(p, y), F.lit(PROB_FLOOR)))


def negative_nll(p, k, form: str = "complement") -> Column:
    """Loss of a complementary label ``k`` (Q1).

    ``complement``: ``-log(1 - p[k])`` (the published method);
    ``as_written``: ``log p[k] - 1``, what NLLLoss on ``1 - log_softmax`` gives.
    """
    pk = pick(p, k)
    if form == "complement":
        return -F.log(F.greatest(F.lit(1.0) - pk, F.lit(PROB_FLOOR)))
    if form == "as_written":
        return F.log(F.greatest(pk, F.lit(PROB_FLOOR))) - F.lit(1.0)
    raise ValueError(f"unknown form {form!r}")
