"""Controlled label noise and complementary labels.

Noise: rows are put in a keyed random order; the first ``int((1-r)*n)`` stay
clean, the rest get a redrawn label.  Instead of splitting and re-unioning
(two scans), the split is one ``CASE`` on the exact position.  The clean
count uses double arithmetic and truncation, as the reference does (ratio
0.9 of 10 rows leaves 0 clean rows, Q9).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw_mod, shuffle_key
from .order import from_key, shuffled_ordinal

NOISE_KINDS = ("inc", "exc")


def _check(kind: str, num_classes: int, ratio: float):
    if kind not in NOISE_KINDS:
        raise ValueError(f"unknown noise type {kind!r}; expected one of {NOISE_KINDS}")
    if num_classes < 1 or (kind == "exc" and num_classes < 2):
        raise ValueError("exclusive noise needs at least 2 classes")
    if not 0.0 <= ratio <= 1.0:
        raise ValueError("noise ratio must be in [0, 1]")


def noisy_label(kind: str, label: Column, num_classes: int, seed: int, id_col: str) -> Column:
    """Redrawn label: ``inc`` uniform over all classes (may keep the label),
    ``exc`` uniform over the other classes (always changes it)."""
    if kind == "inc":
        return draw_mod(seed, "inc", num_classes, id_col).cast("int")
    step = F.lit(1) + draw_mod(seed, "exc", num_classes - 1, id_col)
    return F.pmod(label.cast("long") + step, F.lit(num_classes)).cast("int")


def inject_noise(df: DataFrame, num_classes: int, ratio: float, kind: str = "inc",
                 seed: int = 7, id_col: str = "id", label_col: str = "label",
                 with_position: bool = False, num_partitions: int | None = None) -> DataFrame:
    """Corrupt ``label_col`` on an exact share ``ratio`` of the rows.

    Adds ``label_clean`` (the given label), ``is_noisy_row`` (in the noisy part)
    and ``is_flipped`` (label actually changed); with ``with_position`` also
    ``shuffle_pos``, the row's place in the keyed order (the reference's row
    order of the result).

    The key at position ``int((1-r)*n)`` is found by histograms of its digits
    (:func:`~sievetext.operators.order.key_at`) and every row is flagged by
    comparing its own key with that cut-off: nothing is sorted or moved.
    ``with_position`` range-sorts the narrow ``(md5 key, id)`` pairs and joins
    the positions back on the id.
    """
    _check(kind, num_classes, ratio)
    key = shuffle_key(seed, "shuffle", id_col)
    if with_position:
        ordered = shuffled_ordinal(df.select(id_col), seed=seed, purpose="shuffle", id_col=id_col,
                                   name="shuffle_pos", total="_n", num_partitions=num_partitions)
        base = df.join(ordered, id_col)
        noisy = F.col("shuffle_pos") >= F.floor(F.lit(1.0 - float(ratio)) * F.col("_n"))
    else:
        base = df
        noisy = from_key(df, key, id_col, lambda n: int((1.0 - float(ratio)) * n))
    clean = F.col(label_col)
    new = F.when(noisy, noisy_label(kind, clean, num_classes, seed, id_col)).otherwise(clean.cast("int"))
    out = (base.withColumn("label_clean", clean.cast("int"))
           .withColumn("is_noisy_row", noisy)
           .withColumn(label_col, new)
           .withColumn("is_flipped", F.col(label_col) != F.col("label_clean")))
    return out.drop("_n")


def generate_noise(df: DataFrame, noise_type: str = "inc", num_classes: int = 6,
                   noise_ratio: float = 0.3, **kw) -> DataFrame:
    """Dispatcher with the reference's defaults (N3); unknown types raise (Q8)."""
    return inject_noise(df, num_classes, noise_ratio, kind=noise_type, **kw)


def complement_label(label: Column | str, num_classes: int, epoch: Column | int,
                     seed: int = 7, id_col: str = "id") -> Column:
    """A label uniform over the classes other than ``label`` (N4), drawn anew
    per epoch but reproducibly: ``(y + 1 + draw(seed,'comp',epoch,id) % (c-1)) % c``.
    With c = 2 it is simply the other class."""
    if num_classes < 2:
        raise ValueError("complementary labels need at least 2 classes")
    y = F.col(label) if isinstance(label, str) else label
    step = F.lit(1) + draw_mod(seed, "comp", num_classes - 1, epoch, id_col)
    return F.pmod(y.cast("long") + step, F.lit(num_classes)).cast("int")


def with_complement(df: DataFrame, num_classes: int, epoch: int, seed: int = 7,
                    id_col: str = "id", label_col: str = "y", out_col: str = "comp") -> DataFrame:
    return df.withColumn(out_col, complement_label(label_col, num_classes, epoch, seed, id_col))
