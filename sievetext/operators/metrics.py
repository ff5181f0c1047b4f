"""Epoch losses, accuracy and label audits."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vecmath import argmax
from .order import with_ordinal


def epoch_loss(rows: DataFrame, loss_col: str = "loss", batch_size: int = 512,
               order_by: Sequence[Column | str] = ("id",),
               extra_means: dict | None = None) -> DataFrame:
    """One row: ``n_rows``, ``loss_mean`` (per row) and ``loss_reported`` (Q11:
    the sum of per-batch means divided by the number of rows, as the reference
    prints it).  Batches are consecutive in ``order_by``.
    """
    extra_means = extra_means or {}
    ordered = with_ordinal(rows, list(order_by), name="_pos")
    b = ordered.withColumn("_batch", F.floor(F.col("_pos") / F.lit(batch_size)))
    per_batch = b.groupBy("_batch").agg(
        F.count(F.lit(1)).alias("_cnt"), F.sum(loss_col).alias("_sum"), F.avg(loss_col).alias("_mean"),
        *[F.sum(c).alias(f"_x_{c}") for c in extra_means])
    n = F.sum("_cnt")
    return per_batch.agg(
        n.cast("long").alias("n_rows"),
        F.round(F.sum("_sum") / n, 6).alias("loss_mean"),
        F.round(F.sum("_mean") / n, 6).alias("loss_reported"),
        *[F.round(F.sum(f"_x_{c}") / n, 6).alias(name) for c, name in extra_means.items()])


def accuracy(scored: DataFrame, probs_col: str = "probs", y_col: str = "y") -> DataFrame:
    """Percent of rows whose arg-max class equals the target (A5)."""
    hit = (argmax(probs_col) == F.col(y_col)).cast("int")
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(hit).cast("long").alias("n_correct"),
                      (F.lit(100.0) * F.avg(hit.cast("double"))).alias("accuracy"))


def label_audit(preds: DataFrame, actual: str = "actual_label",
                predicted: str = "predicted_label") -> DataFrame:
    """Row-wise flag actual == predicted as 1/0."""
    return preds.withColumn("is_equal", F.when(F.col(actual) == F.col(predicted), 1).otherwise(0))


def label_audit_all(preds: DataFrame, actual: str = "actual_label",
                    predicted: str = "predicted_label") -> DataFrame:
    """Are the two columns equal on every row (A6, null-safe), with counts."""
    eq = F.col(actual).eqNullSafe(F.col(predicted))
    return preds.agg(F.count(F.lit(1)).alias("n_rows"),
                     F.sum(F.when(F.col(actual) == F.col(predicted), 1).otherwise(0)).cast("long").alias("n_equal"),
                     F.every(eq).alias("all_equal"))
