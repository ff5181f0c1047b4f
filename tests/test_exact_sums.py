"""Sums that do not depend on the order of the rows, and training with them."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievetext.operators import exact
from sievetext.operators.model import SoftmaxHead, gradient
from sievetext.plans.train import Adam, Trainer

_GRID = 1 << 60


def _on_grid(v: float) -> Fraction:
    """The value on the grid that digit planes stop at."""
    return Fraction(round(Fraction(v) * _GRID), _GRID)


_NUMBERS = st.floats(-1e9, 1e9, allow_nan=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(_NUMBERS, _NUMBERS), min_size=1, max_size=30))
def test_products_are_the_exact_ones_rounded_once(pairs):
    a, b = (np.array(c)[:, None] for c in zip(*pairs))
    want = sum((_on_grid(x) * _on_grid(y) for x, y in pairs), Fraction(0))
    assert exact.rounded(exact.exact_products(a, b))[0, 0] == float(want)


def test_order_and_cuts_do_not_matter():
    rng = np.random.default_rng(3)
    A = rng.normal(size=(40_000, 3)) * 10.0 ** rng.integers(-9, 9, size=(40_000, 1))
    B = rng.normal(size=(40_000, 5))
    whole = exact.carried(exact.exact_products(A, B))
    order = rng.permutation(len(A))
    parts = [exact.exact_products(A[p], B[p]) for p in np.array_split(order, 7)]
    assert np.array_equal(whole, exact.carried(sum(parts)))
    assert np.allclose(exact.rounded(whole), A.T @ B, rtol=1e-9)


def test_cancelling_terms_leave_the_small_one():
    got = exact.rounded(exact.exact_total(np.array([2.0 ** 50, 2.0 ** -40, -(2.0 ** 50)])))
    assert got[0, 0] == 2.0 ** -40
    assert exact.rounded(exact.exact_total(np.array([])))[0, 0] == 0.0


@pytest.mark.parametrize("bad", [math.nan, math.inf, -math.inf, 2.0 ** 60])
def test_numbers_beyond_the_grid_raise(bad):
    with pytest.raises(ValueError):
        exact.exact_total(np.array([1.0, bad]))


def _rows(spark, n=3000, c=4, d=9):
    rng = np.random.default_rng(11)
    y = rng.integers(0, c, n)
    X = rng.normal(size=(n, d)) + 2.0 * np.eye(c, d)[y]
    return spark.createDataFrame([(i, int(k), x.tolist()) for i, (k, x) in enumerate(zip(y, X))],
                                 "id long, y int, features array<double>")


def test_exact_gradient_equals_the_plain_one(spark):
    df = _rows(spark)
    model = SoftmaxHead(np.random.default_rng(5).normal(size=(4, 9)))
    comp = df.selectExpr("id", "y", "features", "cast((y + 1) % 4 as int) as comp")
    for kw in ({"kind": "pl"}, {"kind": "nl", "comp_col": "comp"}, {"kind": "pl", "threshold": 0.5},
               {"kind": "nl", "comp_col": "comp", "form": "as_written"}):
        plain, same = gradient(comp, model, **kw), gradient(comp, model, exact=True, **kw)
        assert (plain["n"], plain["seen"], plain["correct"]) == (same["n"], same["seen"], same["correct"])
        assert np.allclose(plain["grad"], same["grad"], atol=1e-12)
        assert plain["loss"] == pytest.approx(same["loss"]) and plain["aux_loss"] == pytest.approx(same["aux_loss"])


def test_no_rows(spark):
    got = gradient(_rows(spark).where("id < 0"), SoftmaxHead.zeros(4, 9), kind="pl", exact=True)
    assert got["n"] == 0 and not got["grad"].any()


def test_history_is_the_same_for_any_partitioning(spark):
    df = _rows(spark)
    runs = []
    for parts in (1, 4, 8):
        # another number of rows per Arrow batch as well
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(10_000 // parts + parts))
        try:
            rows = df.repartition(parts, "id").sortWithinPartitions("features")
            tr = Trainer(4, 9, Adam(lr=0.1), reproducible=True, eval_every=1)
            tr.fit(rows, 2, "nl", dev=rows, test=rows)
            tr.fit(rows, 1, "nl", select="selnl", dev=rows)
            tr.fit(rows, 2, "pl", select="selpl", dev=rows, test=rows)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        runs.append((tr.model.flat().tobytes(), [{k: v for k, v in h.items() if k != "seconds"} for h in tr.history]))
    assert runs[0] == runs[1] == runs[2]
