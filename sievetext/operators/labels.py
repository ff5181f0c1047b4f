"""Label maps and class counts.

The class list is the one thing the driver must hold (the model has one row
of weights per class), so it is collected, behind an explicit bound: more than
``MAX_CLASSES`` distinct values raise, because such a column is not a class label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CLASSES = 10_000
_INLINE_CLASSES = 64


def collect_labels(df: DataFrame, label_col: str = "label",
                   max_classes: int = MAX_CLASSES) -> list:
    """Sorted distinct non-null labels; raises if there are more than ``max_classes``."""
    got = (df.select(label_col).where(F.col(label_col).isNotNull()).distinct()
           .limit(max_classes + 1).collect())
    if len(got) > max_classes:
        raise ValueError(f"more than {max_classes} distinct values in {label_col!r}: "
                         "not a class label")
    return sorted(r[0] for r in got)


def label_code_frame(spark, labels: list, label_col: str = "label",
                     code_col: str = "code") -> DataFrame:
    """``(label, code)`` with codes 0..c-1 in ascending label order."""
    return spark.createDataFrame([(lab, i) for i, lab in enumerate(labels)],
                                 f"{label_col} {_ddl_type(labels)}, {code_col} int")


def _ddl_type(labels: list) -> str:
    if labels and all(isinstance(x, bool) for x in labels):
        return "boolean"
    if labels and all(isinstance(x, int) for x in labels):
        return "bigint"
    if labels and all(isinstance(x, (int, float)) for x in labels):
        return "double"
    return "string"


def code_expr(col: Column | str, labels: list) -> Column:
    """Class code of a label column for a small class list (no join): -1 if it is
    absent or null."""
    c = F.col(col) if isinstance(col, str) else col
    arr = F.array(*[F.lit(v) for v in labels])
    return (F.coalesce(F.array_position(arr, c), F.lit(0)) - 1).cast("int")


def encode_labels(df: DataFrame, labels: list, label_col: str = "label",
                  code_col: str = "y", strict: bool = True) -> DataFrame:
    """Replace labels by codes 0..c-1.

    Up to 64 classes the code is an inline expression; beyond, a broadcast
    join with the collected (bounded) class list; a null label is missing from
    any list, on both paths.  ``strict`` looks for rows whose label is missing
    first and raises, naming up to 20 labels and counting the rows (Q15).
    """
    if len(labels) <= _INLINE_CLASSES:
        out = df.withColumn(code_col, code_expr(label_col, labels))
        missing = F.col(code_col) < 0
    else:
        codes = label_code_frame(df.sparkSession, labels, "_lab", code_col)
        out = df.join(F.broadcast(codes), F.col(label_col) == F.col("_lab"), "left").drop("_lab")
        missing = F.col(code_col).isNull()
    if strict:
        bad = out.where(missing).groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
        first = bad.orderBy(F.col("n").desc(), label_col).limit(20).collect()
        if first:
            rows = bad.agg(F.sum("n")).first()[0]
            raise KeyError(f"{rows} rows with labels not in the label map: "
                           f"{[r[0] for r in first]}")
    return out.where(~missing) if not strict else out


def class_count(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Number of classes = distinct labels (Q4), with the reference's ``max`` beside it."""
    return df.agg(F.count_distinct(label_col).cast("long").alias("num_classes"),
                  F.max(label_col).alias("max_label"))
