"""Confidence selection.

A row is kept when the model's probability of its (possibly noisy) label is
strictly over a threshold: ``1/c`` for SelNL, ``gamma`` for SelPL.  The
probability is compared, not its logarithm (Q2), and SelPL's threshold is
``gamma`` itself (Q3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vecmath import pick

GAMMA = 0.5  # SelPL threshold of the reference runner


def selection_threshold(kind: str, num_classes: int, gamma: float = GAMMA) -> float:
    if kind == "selnl":
        return 1.0 / float(num_classes)
    if kind == "selpl":
        return float(gamma)
    raise ValueError("kind must be 'selnl' or 'selpl'")


def confident_rows(scored: DataFrame, threshold: float, probs_col: str = "probs",
                   y_col: str = "y", out_col: str = "p_y") -> DataFrame:
    """Rows with ``p[y] > threshold``; adds ``p_y``."""
    return scored.withColumn(out_col, pick(probs_col, y_col)).where(F.col(out_col) > F.lit(float(threshold)))


def selection_or_none(scored: DataFrame, threshold: float, **kw):
    """The selected rows, or ``None`` when nothing passes (the reference's
    signal to stop)."""
    kept = confident_rows(scored, threshold, **kw)
    return None if kept.isEmpty() else kept
