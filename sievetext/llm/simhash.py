"""SimHash near-duplicates through a byte-position inverted index.

Two 64-bit fingerprints that differ in at most ``max_bits`` = 3 bits agree in at
least 5 of their 8 bytes (count filtering).  Any 5 positions contain one of the
14 position quadruples whose numbers xor to zero (every 3 positions lie in
exactly one of them, and so does every complement), so the index posts each
distinct fingerprint under 14 keys of four positional bytes.  Pairs that meet
under a key are tallied over all eight positions, those with 5 shared bytes or
more are verified by their bit distance, and a pair counts only under the first
quadruple it shares.

Copies collapse to one fingerprint first.  Postings of more than ``max_posting``
fingerprints are never paired: their members are linked exactly through
neighbourhood keys (values within one bit of one fingerprint and two bits of
another), a number of rows proportional to the members; each value keeps links
to one member only, so components stay whole.  A pair whose first shared
quadruple is over-long has both its members there, so none is lost.

Defined cases: null, empty and blank texts have fingerprint zero and link like
any other; texts of fewer than three words hash their whole word sequence; each
repeated row gets its own row; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_name, give_back, small_batches
from .graph import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
MAX_POSTING = 256
QUADS = [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]
MIN_SHARED = 8 - MAX_BITS


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text as an unsigned 64-bit number."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) > shingle:
        starts, ends = starts[:1 - shingle], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_digest  # big-endian bytes
    total = np.zeros(64, np.int64)
    starts, ends = starts.tolist(), ends.tolist()
    for k in range(0, len(starts), 1 << 16):  # bounded blocks of a long text
        raw = b"".join([digest(line[a:b], SEED)
                        for a, b in zip(starts[k:k + (1 << 16)], ends[k:k + (1 << 16)], strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def _fingerprint_udf(shingle: int):
    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
        give_back()
        return pa.array(found.view(np.int64))

    return simhash


def with_fingerprint(docs: DataFrame, text_col: str = "text", output: str = "fingerprint",
                     shingle: int = SHINGLE) -> DataFrame:
    """``docs`` plus the fingerprint as a signed 64-bit number."""
    return small_batches(docs).withColumn(output, _fingerprint_udf(shingle)(F.col(text_col).cast("string")))


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _keys(fp: Column) -> Column:
    """The 14 posting keys: quadruple number above four positional bytes."""
    keys = []
    for k, quad in enumerate(QUADS):
        packed = F.lit(k).cast("long")
        for p in quad:
            packed = F.shiftleft(packed, 8).bitwiseOR(_byte(fp, p))
        keys.append(packed)
    return F.array(*keys)


def _shared_first(diff: Column) -> Column:
    """Number of the first quadruple on whose positions both sides agree."""
    same = [_byte(diff, p) == 0 for p in range(8)]
    out = F.lit(len(QUADS))
    for k, q in reversed(list(enumerate(QUADS))):
        out = F.when(same[q[0]] & same[q[1]] & same[q[2]] & same[q[3]], F.lit(k)).otherwise(out)
    return out.cast("long")


def _tally(diff: Column) -> Column:
    """How many positional bytes both sides share."""
    return sum(((_byte(diff, p) == 0).cast("int") for p in range(8)), F.lit(0))


def _near(bits: int) -> list[int]:
    """Masks of at most ``bits`` of 64 bits, as signed numbers."""
    masks = [sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(64), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _dense_links(members: DataFrame) -> DataFrame:
    """Exact links among fingerprints of over-long postings, without pairing a
    posting: values within one bit of a fingerprint are the meeting points;
    fingerprints within one or two bits of a meeting point link to its least
    one-bit member, which is at most three bits away."""
    def around(bits):
        masks = F.array(*[F.lit(m) for m in _near(bits)])
        return members.select("fp", F.explode(masks).alias("m")).select(
            "fp", F.col("fp").bitwiseXOR(F.col("m")).alias("value"))

    hubs = around(1).groupBy("value").agg(F.min("fp").alias("hub"))
    return (around(2).join(hubs, "value").where("fp <> hub")
            .select(F.greatest("fp", "hub").alias("a"), F.least("fp", "hub").alias("b")).distinct())


def links(prints: DataFrame, max_posting: int = MAX_POSTING) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``fp``) at a bit
    distance of at most three: all of them under short postings, enough to keep
    components whole under over-long ones."""
    spark = prints.sparkSession
    postings = prints.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    sizes = materialize(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "postings")
    short = postings.join(sizes.where(F.col("n") <= max_posting).select("key"), "key")
    short = materialize(short, "short-postings")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    found = (short.select(F.col("fp").alias("a"), "key")
             .join(short.select(F.col("fp").alias("b"), "key"), "key")
             .where((F.col("a") > F.col("b"))
                    & (_tally(diff) >= MIN_SHARED)
                    & (F.bit_count(diff) <= MAX_BITS)
                    & (_shared_first(diff) == F.shiftright("key", 32)))
             .select("a", "b"))
    if sizes.where(F.col("n") > max_posting).isEmpty():
        return found
    dense = postings.join(sizes.where(F.col("n") > max_posting).select("key"), "key").select("fp").distinct()
    return found.unionByName(_dense_links(materialize(dense, "dense"))).distinct()


def fingerprint_components(prints: DataFrame, max_posting: int = MAX_POSTING) -> DataFrame:
    """``(fp, first)`` from ``(fp, first)`` of distinct fingerprints: the least
    ``first`` of every component in place of the fingerprint's own."""
    roots = components(links(prints.select("fp"), max_posting))
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    return placed.join(least, "root").select("fp", F.col("least").alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_posting: int = MAX_POSTING) -> DataFrame:
    """One row per document: id, ``fingerprint`` (signed) and ``component_id``,
    the least id reachable over links (null where no reachable row has an id)."""
    ids = with_fingerprint(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")),
                           "_text", "fingerprint", shingle).select("_id", "fingerprint")
    ids = materialize(ids, "fingerprints")
    prints = materialize(ids.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("_id").alias("first")),
                         "prints")
    found = fingerprint_components(prints, max_posting).withColumnRenamed("first", "component_id")
    return ids.join(found, ids["fingerprint"] == found["fp"]).select(
        F.col("_id").alias(id_col), "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, max_posting: int = MAX_POSTING) -> DataFrame:
    """``docs`` with one row of every component: the least id (null ids last;
    of rows with one id, the first written).  Columns and their order stay."""
    row, fp = free_name(docs, "row_number"), free_name(docs, "fingerprint")
    numbered = with_fingerprint(docs, text_col, fp, shingle).withColumn(row, F.monotonically_increasing_id())
    numbered = materialize(numbered, "numbered")
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    prints = numbered.groupBy(F.col(fp).alias("fp")).agg(F.min(rank).alias("first"))
    found = fingerprint_components(materialize(prints, "prints"), max_posting)
    stay = found.select(F.col("first.row").alias(row)).distinct()
    return numbered.join(stay, row, "left_semi").select(*docs.columns)


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    """The rows of the registered query: fingerprints as 16 hex digits."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
