"""Look-up joins that stay cheap when one key holds a large share of rows.

A token table joined with a large dictionary (word index, vector table)
shuffles every token occurrence.  Word frequencies are Zipfian: a bounded set
of hot keys (the most frequent words) covers most occurrences.  The split
look-up resolves hot keys with a broadcast of that bounded set, where the
rows lie, and sends only the remaining (rare-key) rows through the shuffle
join with the full dictionary.  Every row is resolved exactly once; nothing
is capped or dropped.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_lookup(left: DataFrame, table: DataFrame, key: str, hot: DataFrame,
                 values: Sequence[str]) -> DataFrame:
    """Left join ``left`` with ``table`` on ``key``, hot keys by broadcast.

    ``hot`` is a subset of ``table`` (same ``key`` and ``values`` columns)
    whose size the caller has bounded.  Rows whose key is null or hot are
    answered by the broadcast; the others by a shuffle join with ``table``.
    """
    cols = left.columns
    # one row per hot key, whatever the caller passed (the hot side is bounded)
    marked = hot.select(key, *values).dropDuplicates([key]).withColumn("_hot", F.lit(True))
    tagged = left.join(F.broadcast(marked), key, "left")
    done = F.col("_hot").isNotNull() | F.col(key).isNull()
    hit = tagged.where(done).select(*cols, *values)
    rest = tagged.where(~done).select(*cols).join(table.select(key, *values), key, "left")
    return hit.unionByName(rest.select(*cols, *values))


def hot_keys(counts: DataFrame, key: str, count_col: str, k: int) -> DataFrame:
    """The ``k`` most frequent keys (ties by key), at most ``k`` rows.

    Ranked with the distributed ordinal (range sort on count, key) and cut at
    position ``k`` -- not ``orderBy().limit(k)``, whose top-k merge would send
    ``k`` rows from every partition into one task when ``k`` is large.
    """
    from .order import with_ordinal

    ranked = with_ordinal(counts.select(key, count_col), [F.col(count_col).desc(), F.col(key)],
                          name="_rank")
    return ranked.where(F.col("_rank") < F.lit(int(k))).select(key)
