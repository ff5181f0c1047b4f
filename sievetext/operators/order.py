"""Exact ordinals, batches and exact-count splits.

An exact position in a total order is what dense word ids, exact-count noise
splits and fixed-size batches need.  ``row_number()`` over an unpartitioned
window would pull every row into one task, so the ordinal is built the way a
distributed ``zipWithIndex`` is:

1. range-repartition on the order keys into a fixed number of partitions
   (keys end with a unique id, so one hot key value is still split), sort
   inside each and number its rows from 0;
2. write these rows once to the shared scratch folder, with their partition;
3. count the written rows per partition (partial aggregation) and prefix-sum
   the counts (one row per partition, so the table is bounded by the partition
   count);
4. add the partition's offset to each written row.

The counts and the rows are read from the same written table.  Two readers of
one lazy range shuffle would not do: Spark prunes them to different columns,
each then samples range bounds of its own, and offsets no longer fit.  A lost
executor re-reads the table.  Callers pass only the columns they need, since
these are written.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import shuffle_key
from ..session import input_partitions, materialize

_PART_BITS = 33


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    """Explicit count, else the larger of ``spark.sql.shuffle.partitions`` and
    the input's partition count as the planner estimates it (so a huge input
    keeps input-sized partitions through the range sort)."""
    if num_partitions:
        return int(num_partitions)
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(conf, input_partitions(df) or 0)


def with_ordinal(df: DataFrame, order_by: Sequence[Column | str], name: str = "pos",
                 total: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based bigint ``name`` = position of the row in ``order_by``.

    ``order_by`` must be a total order (end it with a unique id).  With
    ``total`` set, a column of that name carries the row count of ``df``.
    """
    n_parts = _num_partitions(df, num_partitions)
    keys = [F.col(k) if isinstance(k, str) else k for k in order_by]
    local = F.monotonically_increasing_id() - F.shiftleft(
        F.spark_partition_id().cast("long"), _PART_BITS)
    body = materialize(df.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
                       .withColumn("_ord_part", F.spark_partition_id())
                       .withColumn("_ord_local", local), "ranged")
    counts = body.groupBy("_ord_part").agg(F.count(F.lit(1)).alias("_ord_cnt"))
    running = Window.orderBy("_ord_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    offsets = counts.select(
        "_ord_part",
        F.coalesce(F.sum("_ord_cnt").over(running), F.lit(0)).cast("long").alias("_ord_off"),
        F.sum("_ord_cnt").over(every).cast("long").alias("_ord_total"),
    )
    out = (body.join(F.broadcast(offsets), "_ord_part")
           .withColumn(name, F.col("_ord_off") + F.col("_ord_local")))
    if total:
        out = out.withColumnRenamed("_ord_total", total)
    return out.drop("_ord_part", "_ord_local", "_ord_off", "_ord_total")


#: Rows of the last histogram bin that are compared one by one.
SMALL_BIN = 65_536
_DIGITS = 4


def key_at(df: DataFrame, key: Column, id_col: str, place) -> tuple[int, str | None, object]:
    """Row count ``n``, and the ``(key, id)`` at position ``place(n)`` of the order
    by them (``None, None`` where there is no such position).

    Nothing is sorted or moved: ``key`` is a hex digest, and each pass counts the
    rows per next 16 bits of those that share the digits found so far, 65,536
    counts at most.  A bin of few rows ends the search; digests are spread
    evenly, so two or three passes over the ids do for any table.  Equal
    digests (repeated ids) are told apart by the id.
    """
    rows = df.select(key.alias("_k"), F.col(id_col).alias("_i"))
    found, n, left, size = "", None, 0, 0
    while n is None or (size > SMALL_BIN and len(found) < 32):
        part = rows.where(F.col("_k").startswith(found)) if found else rows
        bins = part.groupBy(F.substring("_k", len(found) + 1, _DIGITS).alias("d")).count().collect()
        if n is None:
            n = sum(r["count"] for r in bins)
            left = place(n)
            if not 0 <= left < n:
                return n, None, None
        for r in sorted(bins, key=lambda r: r["d"]):
            if left < r["count"]:
                found, size = found + r["d"], r["count"]
                break
            left -= r["count"]
    part = rows.where(F.col("_k").startswith(found)).groupBy("_k", "_i").count()
    # Whole digests alike mean one id; a bin of more is not met.
    for r in sorted(part.limit(SMALL_BIN).collect(), key=lambda r: (r["_k"], r["_i"])):
        if left < r["count"]:
            return n, r["_k"], r["_i"]
        left -= r["count"]
    raise RuntimeError("the ids changed between two passes")


def from_key(df: DataFrame, key: Column, id_col: str, place) -> Column:
    """True for the rows from position ``place(n)`` of the order by (key, id) on:
    each row is compared with the cut-off, so none is moved."""
    _, at, row_id = key_at(df, key, id_col, place)
    if at is None:
        return F.lit(False)
    least = F.lit(row_id).cast(df.schema[id_col].dataType)
    return (key > F.lit(at)) | ((key == F.lit(at)) & (F.col(id_col) >= least))


def running_total(df: DataFrame, order_by: Sequence[Column | str], weight: str, name: str = "before",
                  total: str = "total", num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = sum of ``weight`` over the rows before this one in ``order_by``
    and ``total`` over all, exactly: sums within ranges, and one row per range
    for the offsets.  As :func:`with_ordinal`, the ranged rows are written once."""
    keys = [F.col(k) if isinstance(k, str) else k for k in order_by]
    body = materialize(df.repartitionByRange(_num_partitions(df, num_partitions), *keys)
                       .withColumn("_part", F.spark_partition_id()), "ranged")
    sums = body.groupBy("_part").agg(F.sum(weight).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"),
                          F.sum("_sum").over(Window.partitionBy(F.lit(0))).alias(total))
    within = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (body.withColumn("_in", F.coalesce(F.sum(weight).over(within), F.lit(0)))
            .join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_off") + F.col("_in")).drop("_part", "_in", "_off"))


def keyed_shuffle_order(df: DataFrame, seed: int = 7, purpose: str = "shuffle",
                        id_col: str = "id") -> DataFrame:
    """Attach ``_shuffle`` = md5 of ``seed:purpose:id`` (O1): sort by it, then id."""
    return df.withColumn("_shuffle", shuffle_key(seed, purpose, id_col))


def shuffled_ordinal(df: DataFrame, seed: int = 7, purpose: str = "shuffle",
                     id_col: str = "id", name: str = "pos", total: str | None = None,
                     num_partitions: int | None = None) -> DataFrame:
    """Exact position of each row in a keyed random order (``df.sample(frac=1)``)."""
    keyed = keyed_shuffle_order(df, seed, purpose, id_col)
    return with_ordinal(keyed, ["_shuffle", id_col], name=name, total=total,
                        num_partitions=num_partitions).drop("_shuffle")


def batches(df: DataFrame, batch_size: int, order_by: Sequence[Column | str] = ("id",),
            drop_last: bool = False, shuffle: bool = False, seed: int = 7,
            id_col: str = "id", num_partitions: int | None = None) -> DataFrame:
    """Consecutive batches of ``batch_size`` rows.

    Adds ``pos`` and ``batch_id``.  ``drop_last`` removes an incomplete last
    batch; ``shuffle`` orders rows by a keyed draw first.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    if shuffle:
        ordered = shuffled_ordinal(df, seed=seed, id_col=id_col, total="_n",
                                   num_partitions=num_partitions)
    else:
        ordered = with_ordinal(df, list(order_by), total="_n", num_partitions=num_partitions)
    out = ordered.withColumn("batch_id", F.floor(F.col("pos") / F.lit(batch_size)).cast("long"))
    if drop_last:
        full = F.floor(F.col("_n") / F.lit(batch_size)) * F.lit(batch_size)
        out = out.where(F.col("pos") < full)
    return out.drop("_n")


def exact_split(df: DataFrame, fraction: float, seed: int = 7, purpose: str = "valid",
                id_col: str = "id", name: str = "is_valid",
                num_partitions: int | None = None, with_position: bool = True) -> DataFrame:
    """Keyed random split with an exact count (O4, ``split_by_rand_pct``).

    The last ``int(fraction * n)`` rows of the keyed order get ``name`` true.
    ``randomSplit`` is not used: its counts are inexact and depend on
    partitioning.  Without positions the rows stay where they are
    (:func:`key_at`).
    """
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must be in [0, 1]")
    if not with_position:
        return df.withColumn(name, from_key(df, shuffle_key(seed, purpose, id_col), id_col,
                                            lambda n: n - int(float(fraction) * n)))
    ordered = shuffled_ordinal(df, seed=seed, purpose=purpose, id_col=id_col, total="_n",
                               num_partitions=num_partitions)
    n_valid = F.floor(F.lit(float(fraction)) * F.col("_n"))
    return ordered.withColumn(name, F.col("pos") >= F.col("_n") - n_valid).drop("_n")


def tail_split(df: DataFrame, n_tail: int, order_by: Sequence[Column | str] = ("id",),
               name: str = "is_valid", num_partitions: int | None = None) -> DataFrame:
    """All rows but the last ``n_tail`` in order are train, the tail is
    validation (P7, the position slices of the pre-encoded loader)."""
    ordered = with_ordinal(df, list(order_by), total="_n", num_partitions=num_partitions)
    return ordered.withColumn(name, F.col("pos") >= F.col("_n") - F.lit(int(n_tail))).drop("_n")


def subset(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of ``df`` whose id is in ``ids`` (O6, the subset sampler): a
    left-semi join, so ``df`` is never widened and duplicates in ``ids`` do
    not duplicate rows."""
    return df.join(ids.select(id_col), id_col, "left_semi")
