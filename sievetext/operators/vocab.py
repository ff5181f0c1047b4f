"""Vocabulary and word indexes.

The vocabulary is a DataFrame ``(token)``; a word index is a DataFrame
``(token, id)`` used for both directions (token -> id and id -> token), never
a map literal, so it can be as large as the corpus makes it.
"""

from __future__ import annotations

from collections import Counter
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .order import with_ordinal

# ---- fixed values --------------------------------------------------------
# Special tokens of the sequence encoder, ids 0-3; words start at 4.
SPECIALS = [("<PAD>", 0), ("<START>", 1), ("<END>", 2), ("<UNK>", 3)]
PAD_ID, START_ID, END_ID, UNK_ID = 0, 1, 2, 3
# Keras-style index of the pre-encoded data sets: offset 3, and <EOS> = 3 for
# the multi-class set only.
KERAS_SPECIALS = [("<PAD>", 0), ("<START>", 1), ("<UNK>", 2)]
KERAS_SPECIALS_EOS = [("<PAD>", 0), ("<START>", 1), ("<UNK>", 2), ("<EOS>", 3)]
KERAS_INDEX_FROM = 3
KERAS_OOV_ID = 2
# --------------------------------------------------------------------------

def explode_tokens(df: DataFrame, tokens_col: str = "tokens", *keep) -> DataFrame:
    """One row per token.  ``explode_outer`` plus a null filter, not
    ``explode``: from a plain explode Catalyst infers ``size(tokens) > 0`` and
    pushes it, with the whole tokenisation, below earlier repartitions."""
    return (df.select(*keep, F.explode_outer(tokens_col).alias("token"))
            .where(F.col("token").isNotNull()))


INDEX_SCHEMA = T.StructType([T.StructField("token", T.StringType(), False),
                             T.StructField("id", T.LongType(), False)])


def vocabulary(*token_tables: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Distinct tokens of the union of the given tables (A1 + U3).

    ``explode`` then ``distinct``: the partial hash aggregate removes repeats
    of frequent tokens before the shuffle, so a token that makes up a third of
    the corpus costs one row per map task.
    """
    if not token_tables:
        raise ValueError("need at least one table")
    exploded = [explode_tokens(t, tokens_col) for t in token_tables]
    allt = exploded[0]
    for t in exploded[1:]:
        allt = allt.unionByName(t)
    return allt.distinct()


def specials_frame(spark, specials: Sequence[tuple[str, int]] = SPECIALS) -> DataFrame:
    return spark.createDataFrame([(t, int(i)) for t, i in specials], INDEX_SCHEMA)


def word_index(vocab: DataFrame, specials: Sequence[tuple[str, int]] = SPECIALS,
               start: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """Dense ids for the vocabulary in binary token order, after the specials.

    The reference enumerates a ``set`` (arbitrary order); here the order is
    the token's, so ids are reproducible.
    """
    first = start if start is not None else (max(i for _, i in specials) + 1 if specials else 0)
    ordered = with_ordinal(vocab.select("token"), ["token"], name="_pos",
                           num_partitions=num_partitions)
    words = ordered.select("token", (F.col("_pos") + F.lit(first)).cast("long").alias("id"))
    if not specials:
        return words
    return specials_frame(vocab.sparkSession, specials).unionByName(words)


def token_counts(*token_tables: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """``(token, count)`` over the given tables (partial + final aggregate)."""
    exploded = [explode_tokens(t, tokens_col) for t in token_tables]
    allt = exploded[0]
    for t in exploded[1:]:
        allt = allt.unionByName(t)
    return allt.groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def frequency_index(counts: DataFrame, index_from: int = KERAS_INDEX_FROM,
                    specials: Sequence[tuple[str, int]] = KERAS_SPECIALS,
                    num_partitions: int | None = None) -> DataFrame:
    """Keras-style index: rank by (count desc, token), id = rank + index_from.

    Rank 1 is the most frequent word.  Specials are added as given; ids of
    specials and words may meet only if ``index_from`` is smaller than the
    number of specials, exactly as in the reference.
    """
    ranked = with_ordinal(counts.select("token", "count"),
                          [F.col("count").desc(), F.col("token")], name="_pos",
                          num_partitions=num_partitions)
    words = ranked.select("token", (F.col("_pos") + F.lit(1 + index_from)).cast("long").alias("id"))
    if not specials:
        return words
    return specials_frame(counts.sparkSession, specials).unionByName(words)


def _summary_rows(capacity: int):
    """Misra-Gries summaries of a task's tokens: at most ``capacity`` counters
    after each batch; making room takes the same number off every count, and the
    numbers add up to the error of all counts (the row without a token)."""
    import pyarrow as pa

    def run(batches):
        held: Counter = Counter()
        error = 0
        for rb in batches:
            values = rb.column("tokens").flatten()
            for pair in values.value_counts().to_pylist():
                if pair["values"] is not None:
                    held[pair["values"]] += pair["counts"]
            if len(held) > capacity:
                off = sorted(held.values(), reverse=True)[capacity]
                held = Counter({t: n - off for t, n in held.items() if n > off})
                error += off
        yield pa.RecordBatch.from_arrays([pa.array([*held, None], pa.string()), pa.array([*held.values(), error], pa.int64())],
                                         ["token", "count"])

    return run


def top_counts(*token_tables: DataFrame, top: int, capacity: int | None = None,
               tokens_col: str = "tokens") -> tuple[DataFrame, bool]:
    """Exact ``(token, count)`` of the ``top`` most frequent tokens at least (ties
    by token), without counting every word of the corpus.

    Summaries of ``capacity`` counters (four times ``top``) per task are added
    up: a token occurs at least as often as they say, and at most the summed
    error more.  Tokens that may reach the ``top``-th count are counted again,
    exactly.  Where the error does not prove that the others cannot (a token
    outside all summaries might), the exact counts of all are returned; the
    flag tells which.
    """
    from .vectors import broadcast_if_small

    if top < 1:
        raise ValueError("top must be >= 1")
    capacity = max(top, capacity or 4 * top)
    texts = token_tables[0].select(F.col(tokens_col).alias("tokens"))
    for t in token_tables[1:]:
        texts = texts.unionByName(t.select(F.col(tokens_col).alias("tokens")))
    merged = materialize(texts.mapInArrow(_summary_rows(capacity), "token string, count bigint")
                         .groupBy("token").agg(F.sum("count").alias("count")), "summary")
    error = int(merged.where(F.col("token").isNull()).agg(F.sum("count")).first()[0] or 0)
    found = merged.where(F.col("token").isNotNull())
    ranked = with_ordinal(found, [F.col("count").desc(), F.col("token")], name="_pos")
    least = ranked.where(F.col("_pos") == top - 1).first()
    if error and (least is None or error >= least["count"]):
        return token_counts(*token_tables, tokens_col=tokens_col), False
    if not error:
        return found.select("token", "count"), True  # nothing was taken off: the sums are exact
    candidates = found.where(F.col("count") + F.lit(error) >= F.lit(least["count"])).select("token")
    candidates, _ = broadcast_if_small(candidates, 256)
    again = explode_tokens(texts).join(candidates, "token", "left_semi")
    return again.groupBy("token").agg(F.count(F.lit(1)).alias("count")), True


def capped_index(*token_tables: DataFrame, num_words: int, index_from: int = KERAS_INDEX_FROM,
                 capacity: int | None = None, tokens_col: str = "tokens") -> DataFrame:
    """The rows of :func:`frequency_index` (no specials) with ids below
    ``num_words`` (T8), by :func:`top_counts`: all that a capped encoding looks up."""
    top = num_words - 1 - index_from
    if top < 1:
        return token_tables[0].sparkSession.createDataFrame([], INDEX_SCHEMA)
    counts, _ = top_counts(*token_tables, top=top, capacity=capacity, tokens_col=tokens_col)
    index = frequency_index(counts, index_from, specials=())
    return index.where(F.col("id") < F.lit(num_words))
