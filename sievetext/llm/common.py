"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of benchmark items that are collected, and built into one automaton, at a time.
BLOCK_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Text bytes of one Arrow batch between Spark and Python.
BATCH_BYTES = 2 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_DEFAULT = 64 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands whole texts to Python in batches of
    :data:`BATCH_BYTES`: rows of long texts fill Spark's default of 64 MB per
    batch and task.  A size that the user has chosen stays."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY).lower() in (f"{_BATCH_DEFAULT}b", str(_BATCH_DEFAULT)):
        conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return df


#: Seconds between two calls of :func:`give_back` that have an effect.
GIVE_BACK_EVERY = 2.0
_given_back = 0.0


def give_back(now: bool = False):
    """Hand memory that this Python worker has freed back to the machine.  The
    allocators keep it otherwise, and a worker that serves one operator after
    another keeps the peak of each.  Does nothing where the C library can't."""
    global _given_back
    if not now and time.monotonic() - _given_back < GIVE_BACK_EVERY:
        return
    _given_back = time.monotonic()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add."""
    return df.drop(*names)


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of an ordered span array, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                 s["end"].cast("string"))), ",")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_sql(column: str) -> str:
    """DuckDB SQL: A-Z of a text column in lower case, null as the empty text."""
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


def crc_sql(column: str) -> str:
    """DuckDB SQL: crc32 of a key as (ASCII) text, bit by bit; null keys count as
    the empty text."""
    return f"""xor(list_reduce(
    list_prepend(cast(4294967295 as ubigint), list_transform(
      list_filter(string_split(coalesce(cast({column} as varchar), ''), ''), lambda c: c <> ''),
      lambda c: cast(ascii(c) as ubigint))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), cast([0, 0, 0, 0, 0, 0, 0, 0] as ubigint[])),
      lambda x, y: xor(x >> 1, cast(3988292384 as ubigint) * (x & 1)))), cast(4294967295 as ubigint))"""
