"""Sums of floats that do not depend on the order of the rows.

Floating-point addition rounds, so a gradient summed over other partitions
differs in its last digits, and weights drift apart over many steps.  Here every
number is first written as digits to the base 2**20 on one fixed grid.  Products
of digits are integers that a double holds exactly, so the matrix product of
two digit planes over up to ``BLOCK_ROWS`` rows has one possible result, in
whatever order it is added.  The digits of the sums are kept as 64-bit integers
per power of the base, with carries propagated, and added from partition to
partition; only the end result is rounded, once.

Numbers take part to an absolute precision of 2**-60 and below 2**59; larger
ones and such that are not finite raise.
"""

from __future__ import annotations

import math

import numpy as np

DIGIT_BITS = 20
_BASE = 1 << DIGIT_BITS
#: Powers of the base that a number's digits have.
LOW, HIGH = -3, 2
#: Powers of the base that a sum of products has; the last one takes what is over.
SUM_LOW, SUM_HIGH = 2 * LOW, 2 * HIGH + 1
PLANES = SUM_HIGH - SUM_LOW + 1
#: Rows whose products of two balanced digits (below 2**38) add up below 2**53.
BLOCK_ROWS = 1 << 14


def digit_planes(values: np.ndarray) -> dict[int, np.ndarray]:
    """``values`` as digits: ``{power: integers as float64}``, planes of zeros left
    out.  Digits lie in -2**19 .. 2**19, so their sum with weights ``2**(20 power)``
    is the value rounded to the grid."""
    rest = np.asarray(values, dtype=np.float64)
    if rest.size and not float(np.abs(rest).max()) < 2.0 ** (DIGIT_BITS * (HIGH + 1) - 1):
        raise ValueError("exact sums need finite numbers below 2**59")
    planes = {}
    for power in range(HIGH, LOW - 1, -1):
        unit = math.ldexp(1.0, DIGIT_BITS * power)
        digits = np.rint(rest / unit)
        if digits.any():
            planes[power] = digits
            rest = rest - digits * unit
    return planes


def zero_sums(shape: tuple[int, ...]) -> np.ndarray:
    return np.zeros((PLANES, *shape), dtype=np.int64)


def carried(sums: np.ndarray) -> np.ndarray:
    """The same sums with every digit but the highest in -2**19 .. 2**19 - 1."""
    out = sums.copy()
    for k in range(PLANES - 1):
        over = (out[k] + (_BASE >> 1)) >> DIGIT_BITS
        out[k] -= over << DIGIT_BITS
        out[k + 1] += over
    return out


def exact_products(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    """Digits of ``A.T @ B`` (n x a, n x b): an array of PLANES x a x b."""
    sums = zero_sums((A.shape[1], B.shape[1]))
    for at in range(0, len(A), BLOCK_ROWS):
        right = digit_planes(B[at:at + BLOCK_ROWS])
        for i, left in digit_planes(A[at:at + BLOCK_ROWS]).items():
            for j, plane in right.items():
                sums[i + j - SUM_LOW] += (left.T @ plane).astype(np.int64)
        sums = carried(sums)
    return sums


def exact_total(values: np.ndarray) -> np.ndarray:
    """Digits of the sum of a vector: PLANES x 1 x 1."""
    return exact_products(np.asarray(values, dtype=np.float64)[:, None], np.ones((len(values), 1)))


def rounded(sums: np.ndarray) -> np.ndarray:
    """The sums as doubles, each rounded once."""
    flat = carried(sums).reshape(PLANES, -1)
    out = np.empty(flat.shape[1])
    for n in range(flat.shape[1]):
        whole = 0
        for k in range(PLANES - 1, -1, -1):
            whole = (whole << DIGIT_BITS) + int(flat[k, n])
        out[n] = whole / (1 << (-DIGIT_BITS * SUM_LOW))  # of integers: rounded to nearest, once
    return out.reshape(sums.shape[1:])


def row_products(X: np.ndarray, W: np.ndarray) -> np.ndarray:
    """``X @ W.T``, every element from its own row alone: a matrix product may add
    a row's terms in another order when the batch has another size."""
    out = np.empty((len(X), W.shape[0]))
    for k, w in enumerate(W):
        out[:, k] = (X * w).sum(axis=1)
    return out
