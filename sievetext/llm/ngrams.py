"""Interpolated modified Kneser-Ney n-gram model over a whole table.

Texts are tokenised once into *blocks* of a bounded number of tokens (64-bit
word hashes, a begin and an end mark around each text).  For every order, from
the longest down, each block sends its distinct n-grams to shards of the hash
space; a shard is a sorted array of gram hashes with counts, memory-mapped by
the worker that fills it, and answers every block that asked.  From a shard the
next lower order gets what it needs: how many words precede a gram (its
continuation count) and, for a context, the sum of counts and the number of
words seen once, twice and more often.  With the answers, in the order of its
own grams, a block scores its texts.

No task holds the model: a block and a shard have a bounded number of entries,
and their number grows with the data.  A gram that is a third of all tokens is
one entry per block.  Blocks are written, so a lost executor repeats its part
with the same blocks; every sum is of whole numbers.

Discounts follow from the counts of counts of an order, (0.5, 1, 1.5) where
those have gaps.  Orders below the highest count continuations, grams at the
start of a text occurrences; the lowest is interpolated with 1 / (V + 1), so
unseen words have a probability.  Words meet as hashes only; two grams of one
hash in a shard raise an error, two words of one hash (5e-20 per pair) do not.

Defined cases: null and empty texts are their end mark alone; repeated rows
count and are scored each; without training rows every token has probability
1 / (V + 1) = 1; an empty table has no rows; key columns keep their names, other
columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import materialize, scratch_path
from .common import crc_mod, crc_sql, lower_sql, small_batches

ORDER = 2
BLOCK_TOKENS = 1_500_000
SHARD_TOKENS = 3_000_000
BEGIN, END = 1, 2
ASK, CONTINUED, CONTEXT = 0, 1, 2
REPLY, STATS = 0, 3
#: What the lowest level's totals hold, in order: types counted 1, 2, 3, 4 and
#: 3 or more times, their sum, training tokens and distinct training tokens.
N_STATS = 8
_GAPS = (0.5, 1.0, 1.5)


# --- arrays ------------------------------------------------------------------

def _planes(column: np.ndarray) -> bytes:
    """First bytes of all entries, then second bytes, and so on: small numbers
    leave planes of zeros."""
    return np.ascontiguousarray(column).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).ravel()


def _coded(column: np.ndarray) -> bytes:
    """A column of 8 bytes an entry: sorted ones by their steps, others by a
    sorted list of their values where these recur, else as they are."""
    column = np.ascontiguousarray(column).view(np.uint64)
    if (column[1:] >= column[:-1]).all():
        return b"s" + _planes(np.diff(column, prepend=np.uint64(0)))
    values, at, times = np.unique(column, return_inverse=True, return_counts=True)
    if 4 * len(values) > 3 * len(column) or int(values[-1]) < 1 << 32:
        return b"p" + _planes(column)
    # Frequent values take small numbers, equally frequent ones keep their order.
    order = np.argsort(-times, kind="stable")
    number = np.empty(len(values), np.int64)
    number[order] = np.arange(len(values))
    return b"v" + len(values).to_bytes(8, "little") + _planes(np.diff(values, prepend=np.uint64(0))) + _planes(
        times.astype(np.int64)) + _planes(number[at])


def _decoded(raw: bytes, n: int) -> np.ndarray:
    kind, raw = raw[:1], raw[1:]
    if kind == b"s":
        return np.cumsum(_from_planes(raw, n), dtype=np.uint64)
    if kind == b"p":
        return _from_planes(raw, n)
    k = int.from_bytes(raw[:8], "little")
    values = np.cumsum(_from_planes(raw[8:8 + 8 * k], k), dtype=np.uint64)
    times = _from_planes(raw[8 + 8 * k:8 + 16 * k], k).view(np.int64)
    order = np.argsort(-times, kind="stable")
    return values[order][_from_planes(raw[8 + 16 * k:], n).view(np.int64)]


def pack(*arrays: np.ndarray) -> bytes:
    """Columns of one length and 8 bytes an entry, compressed."""
    coded = [_coded(a) for a in arrays]
    raw = b"".join([len(arrays[0]).to_bytes(8, "little"), *[len(c).to_bytes(8, "little") for c in coded], *coded])
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpack(data: bytes, columns: int) -> np.ndarray:
    """The columns of :func:`pack` as rows of an int64 matrix."""
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n, *sizes = (int.from_bytes(raw[8 * k:8 * k + 8], "little") for k in range(columns + 1))
    out, at = np.empty((columns, n), np.int64), 8 * (columns + 1)
    for row, size in zip(out, sizes, strict=True):
        row[:] = _decoded(raw[at:at + size], n).view(np.int64)
        at += size
    return out


def unpack_values(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The one column of :func:`pack`: its values, sorted, and the place of each
    entry among them."""
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n, kind, raw = int.from_bytes(raw[:8], "little"), raw[16:17], raw[17:]
    if kind != b"v":
        return np.unique(_decoded(kind + raw, n), return_inverse=True)
    k = int.from_bytes(raw[:8], "little")
    times = _from_planes(raw[8 + 8 * k:8 + 16 * k], k).view(np.int64)
    order = np.argsort(-times, kind="stable")
    return (np.cumsum(_from_planes(raw[8:8 + 8 * k], k), dtype=np.uint64),
            order[_from_planes(raw[8 + 16 * k:], n).view(np.int64)])


def mapped(parts: Iterable[np.ndarray], dtype) -> np.ndarray:
    """The parts one after the other, in a file of the worker that has no name
    any more and is mapped into memory."""
    with tempfile.TemporaryFile() as file:
        for part in parts:
            file.write(np.ascontiguousarray(part, dtype).tobytes())
        file.flush()
        return np.memmap(file, dtype, "r+") if file.tell() else np.zeros(0, dtype)


def mix(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hash of a gram from those of its first and its last words."""
    h = prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h = (h + suffix.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0x165667B19E3779F9)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash space."""
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def routed(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings the entries of one shard together, and the bounds."""
    to = shard_of(hashes, shards)
    return np.argsort(to, kind="stable"), np.append(0, np.cumsum(np.bincount(to, minlength=shards)))


# --- blocks ------------------------------------------------------------------

class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = self[word] = max(xxh64_intdigest(word), 3)
        return h


def tokens(body: bytes, known: Hashes) -> np.ndarray:
    words = body.lower().split()
    out = np.empty(len(words) + 2, np.uint64)
    out[0], out[-1] = BEGIN, END
    out[1:-1] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return out


@dataclass
class Level:
    hashes: np.ndarray
    counts: np.ndarray  # training occurrences
    opens: np.ndarray  # at the begin mark
    at: np.ndarray  # gram that ends at a position, -1 where a text is too short
    prefix: np.ndarray | None = None
    suffix: np.ndarray | None = None


class Grams:
    """Distinct grams of a block per order, up to ``top``, each order sorted by
    the numbers of its beginning and its end among the grams one shorter."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray, lengths: np.ndarray, train: np.ndarray, top: int):
        self.starts = np.append(0, np.cumsum(lengths))[:-1]
        self.within = np.arange(len(at)) - np.repeat(self.starts, lengths)
        trained = np.repeat(train, lengths)
        counted = trained & (self.within > 0)
        self.levels = [Level(hashes, np.bincount(at[counted], minlength=len(hashes)), hashes == BEGIN, at)]
        for k in range(2, top + 1):
            low = self.levels[-1]
            here = np.flatnonzero(self.within >= k - 1)
            key = low.at[here - 1] * len(low.hashes) + low.at[here]
            key, inverse = np.unique(key, return_inverse=True)
            prefix, suffix = np.divmod(key, len(low.hashes))
            at = np.full(len(at), -1, np.int64)
            at[here] = inverse
            counts = np.bincount(inverse[trained[here]], minlength=len(key))
            self.levels.append(Level(mix(low.hashes[prefix], low.hashes[suffix]), counts, low.opens[prefix], at,
                                     prefix, suffix))


def blocks(docs: DataFrame, keys: list[str], text_col: str, train_col: str, size: int) -> DataFrame:
    """Written rows ``(block, docs, tokens, lengths, train, n)`` of about ``size``
    tokens; ``docs`` lists the key columns."""
    types = [docs.schema[k].dataType for k in keys]
    held = pa.struct([(f"k{i}", to_arrow_type(t)) for i, t in enumerate(types)])
    schema = pa.schema([("docs", pa.list_(held)), ("tokens", pa.binary()), ("lengths", pa.binary()),
                        ("train", pa.binary()), ("n", pa.int64())])
    ddl = "docs array<struct<{}>>, tokens binary, lengths binary, train binary, n bigint".format(
        ", ".join(f"k{i}: {t.simpleString()}" for i, t in enumerate(types)))

    def row(parts, kept, train) -> pa.RecordBatch:
        lengths = np.array([len(p) for p in parts], np.int64)
        whole = pa.chunked_array(kept).combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
        return pa.RecordBatch.from_arrays(
            [lists, pa.array([pack(np.concatenate(parts))], pa.binary()), *[pa.array([v.tobytes()], pa.binary()) for v in (lengths, np.array(train, bool))],
             pa.array([int(lengths.sum())])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts, kept, train, n = Hashes(), [], [], [], 0
        for batch in batches:
            rows = pa.StructArray.from_arrays(batch.columns[:len(types)], fields=list(held))
            first = 0
            flags = batch["train"].to_pylist()
            for i, body in enumerate(batch["body"].to_pylist()):
                parts.append(tokens(body, known))
                train.append(bool(flags[i]))
                n += len(parts[-1])
                if n >= size:
                    kept.append(rows.slice(first, i + 1 - first))
                    yield row(parts, kept, train)
                    parts, kept, train, n, first = [], [], [], 0, i + 1
                if len(known) > 500_000:
                    known.clear()
            if first < len(rows):
                kept.append(rows.slice(first))
        if parts:
            yield row(parts, kept, train)

    texts = small_batches(docs).select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"), F.col(train_col).alias("train"))
    path = scratch_path(docs.sparkSession, "token-blocks")
    (texts.mapInArrow(run, ddl).withColumn("block", F.monotonically_increasing_id())
     .write.option("compression", "zstd").parquet(path))
    return docs.sparkSession.read.parquet(path)


def _grams(row: dict, top: int) -> Grams:
    return Grams(*unpack_values(row["tokens"]), np.frombuffer(row["lengths"], np.int64),
                 np.frombuffer(row["train"], bool), top)


# --- counting ----------------------------------------------------------------

def _asks(level: int, order: int, shards: int):
    """Rows of a block's distinct grams of one level, a row a shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = _grams(row, level)
                own = grams.levels[-1]
                # Between the lowest and the highest order, continuations count.
                counts = own.counts if level in (1, order) else np.where(own.opens, own.counts, 0)
                if level == 1:
                    columns = [own.hashes, counts]
                else:
                    low = grams.levels[-2].hashes
                    columns = [low[own.prefix], low[own.suffix], counts]
                turn, bounds = routed(own.hashes, shards)
                parts = [turn[bounds[s]:bounds[s + 1]] for s in range(shards)]
                to = [s for s in range(shards) if len(parts[s])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int64()), pa.array([ASK] * len(to), pa.int32()),
                     pa.array([row["block"]] * len(to), pa.int64()),
                     pa.array([pack(*[c[parts[s]] for c in columns]) for s in to], pa.binary())],
                    ["shard", "kind", "source", "data"])

    return run


_OUT = pa.schema([("kind", pa.int32()), ("target", pa.int64()), ("shard", pa.int64()), ("data", pa.binary()),
                  ("stats", pa.list_(pa.int64()))])
_OUT_DDL = "kind int, target bigint, shard bigint, data binary, stats array<bigint>"


def _out(kind: int, rows: list[tuple[int, bytes]], shard: int, stats=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()),
         pa.array([shard] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
         pa.array([stats] * len(rows), pa.list_(pa.int64()))], schema=_OUT)


def _lower(kind: int, hashes: np.ndarray, columns: list[np.ndarray], shard: int, shards: int) -> pa.RecordBatch:
    """Sums by hash (sorted, so shards follow one another) for the level below."""
    bounds = np.searchsorted(shard_of(hashes, shards), np.arange(shards + 1))
    rows = []
    for s in range(shards):
        part = slice(bounds[s], bounds[s + 1])
        if bounds[s] < bounds[s + 1]:
            rows.append((s, pack(hashes[part], *[c[part] for c in columns])))
    return _out(kind, rows, shard)


def answer(shard: int, rows: list[tuple[int, int, bytes]], level: int, order: int,
           shards: int) -> Iterator[pa.RecordBatch]:
    """What one shard of a level gives: a reply to every block that asked, sums
    for the level below, and its counts of counts."""
    width = 2 if level == 1 else 3
    asked = [(source, data) for kind, source, data in rows if kind == ASK]

    def parts(data):
        *ends, counts = unpack(data, width)
        ends = [e.view(np.uint64) for e in ends]
        return (ends[0] if level == 1 else mix(*ends)), ends if level > 1 else [], counts

    every, back = np.unique(np.concatenate([parts(d)[0] for _, d in asked]), return_inverse=True)
    model = mapped([every], np.uint64)  # the shard's sorted gram hashes
    places = mapped([back], np.int64)  # of all entries asked for, block by block
    del every, back
    raw = np.zeros(len(model), np.int64)
    ends_of = [mapped([np.zeros(len(model), np.uint64)], np.uint64) for _ in range(0 if level == 1 else 2)]

    def placed():
        first = 0
        for source, data in asked:
            _, ends, counts = parts(data)
            yield source, places[first:first + len(counts)], ends, counts
            first += len(counts)

    for _, at, ends, counts in placed():
        raw[at] += counts
        for own, e in zip(ends_of, ends, strict=True):
            own[at] = e
    counts = raw.copy() if level == order or level > 1 else np.zeros(len(model), np.int64)
    context = np.zeros((4, len(model)), np.int64)
    for kind, _, data in rows:
        if kind == CONTINUED:
            hashes, n = unpack(data, 2)
            counts[np.searchsorted(model, hashes.view(np.uint64))] += n
        elif kind == CONTEXT:
            hashes, *sums = unpack(data, 5)
            context[:, np.searchsorted(model, hashes.view(np.uint64))] += np.array(sums)
    for source, at, ends, _ in placed():
        if any((own[at] != e).any() for own, e in zip(ends_of, ends, strict=True)):
            raise ValueError("two n-grams share one 64-bit hash")
        reply = [counts[at]] + ([raw[at]] if level == 1 else []) + (list(context[:, at]) if level < order else [])
        yield _out(REPLY, [(source, pack(*reply))], shard)
    seen = np.flatnonzero(counts)
    if level > 1:
        prefix, suffix = (np.asarray(own)[seen] for own in ends_of)
        n = counts[seen]
        hashes, times = np.unique(suffix, return_counts=True)
        yield _lower(CONTINUED, hashes, [times.astype(np.int64)], shard, shards)
        hashes, back = np.unique(prefix, return_inverse=True)
        sums = [np.bincount(back, w, len(hashes)).astype(np.int64) for w in (n, n == 1, n == 2, n > 2)]
        yield _lower(CONTEXT, hashes, sums, shard, shards)
    n = counts[seen]
    stats = [int((n == k).sum()) for k in (1, 2, 3, 4)] + [
        int((n > 2).sum()), int(n.sum()), int(raw.sum()), int((raw > 0).sum())]
    yield _out(STATS, [(shard, None)], shard, stats)


def _answers(level: int, order: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for shard, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if shard != now:
                    if rows:
                        yield from answer(now, rows, level, order, shards)
                    now, rows = shard, []
                rows.append(tuple(row))
        if rows:
            yield from answer(now, rows, level, order, shards)

    return run


@dataclass
class Counted:
    """Per level from 1: where its outcomes are written, and its totals."""

    shards: int
    paths: dict[int, str] = field(default_factory=dict)
    totals: dict[int, list[int]] = field(default_factory=dict)

    def discounts(self, level: int) -> np.ndarray:
        """Discount of a count of 0, 1, 2 and more."""
        t = self.totals[level]
        if min(t[:3]) == 0:
            return np.array([0.0, *_GAPS])
        y = t[0] / (t[0] + 2 * t[1])
        return np.array([0.0] + [min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.0), float(k)) for k in (1, 2, 3)])


def drop(spark, path: str, parts: list[str]) -> None:
    """Delete parts of a written scratch table."""
    for part in parts:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def count(written: DataFrame, order: int, shard_tokens: int = SHARD_TOKENS) -> Counted:
    """All levels of the model from written blocks, the longest grams first."""
    spark = written.sparkSession
    total = written.agg(F.sum("n")).first()[0] or 0
    out = Counted(max(1, -(-int(total) // shard_tokens)))
    for level in range(order, 0, -1):
        rows = written.select("block", "tokens", "lengths", "train").mapInArrow(
            _asks(level, order, out.shards), "shard bigint, kind int, source bigint, data binary")
        if level < order:
            above = spark.read.schema(_OUT_DDL).parquet(out.paths[level + 1]).where(F.col("kind").isin(CONTINUED, CONTEXT))
            rows = rows.unionByName(above.select(F.col("target").alias("shard"), "kind", F.col("shard").alias("source"), "data"))
        path = out.paths[level] = scratch_path(spark, f"ngrams-{level}")
        parts = min(out.shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), out.shards // 4))
        (rows.repartition(parts, "shard").sortWithinPartitions("shard")
         .mapInArrow(_answers(level, order, out.shards), _OUT_DDL).write.partitionBy("kind").parquet(path))
        if total:
            sums = spark.read.schema(_OUT_DDL).parquet(path).where(F.col("kind") == STATS).agg(
                *[F.sum(F.get("stats", F.lit(k))).alias(f"s{k}") for k in range(N_STATS)]).first()
            out.totals[level] = [int(v or 0) for v in sums]
        else:
            out.totals[level] = [0] * N_STATS
        if level < order:  # what this level needed is not read again
            drop(spark, out.paths[level + 1], [f"kind={k}" for k in (CONTINUED, CONTEXT)])
    return out


# --- scoring -----------------------------------------------------------------

def probabilities(grams: Grams, replies: list[list[np.ndarray]], totals: dict[int, list[int]],
                  discounts: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Per level, the interpolated probability of each distinct gram's last word
    after the words before it."""
    counts = replies[0][0]
    t1, t2, _, _, t3, total, _, types = totals[1]
    d = discounts[1]
    if total:
        spare = (d[1] * t1 + d[2] * t2 + d[3] * t3) / total
        p = [(counts - d[np.minimum(counts, 3)]) / total + spare / (types + 1)]
    else:
        p = [np.full(len(counts), 1 / (types + 1))]
    for k, own in enumerate(grams.levels[1:], 2):
        counts, d, lower = replies[k - 1][0], discounts[k], p[-1][own.suffix]
        total, n1, n2, n3 = (v[own.prefix] for v in replies[k - 2][-4:])
        spare = d[1] * n1 + d[2] * n2 + d[3] * n3
        p.append(np.where(total > 0, (counts - d[np.minimum(counts, 3)] + spare * lower) / np.maximum(total, 1), lower))
    return p


def _scores(order: int, counted: Counted, schema: pa.Schema):
    totals, shards = counted.totals, counted.shards
    discounts = {k: counted.discounts(k) for k in totals}
    train_tokens, types = totals[1][6], totals[1][7]

    def score(row: dict, data: dict[int, list[bytes]], docs: pa.Array) -> pa.RecordBatch:
        grams = _grams(row, order)
        replies = []
        for k, own in enumerate(grams.levels, 1):
            width = 1 + (k == 1) + (4 if k < order else 0)
            turn, _ = routed(own.hashes, shards)
            found = [unpack(d, width) for d in data[k]]
            values = []
            for c in range(width):
                column = np.empty(len(own.hashes), np.int64)
                column[turn] = np.concatenate([f[c] for f in found])
                values.append(mapped([column], np.int64))
            replies.append(values)
        p = probabilities(grams, replies, totals, discounts)
        predicted = grams.within > 0
        best = p[-1][grams.levels[-1].at]
        for k in range(order - 1, 0, -1):  # texts shorter than the order
            best = np.where(grams.within >= k, best, p[k - 1][grams.levels[k - 1].at])
        word = grams.levels[0].at
        known = replies[0][1]
        base = np.log10((known + 1) / (train_tokens + types + 1))[word]
        sums = [np.add.reduceat(np.where(predicted, v, 0), grams.starts) for v in
                (predicted.astype(np.int64), (known > 0)[word].astype(np.int64), base, np.log10(best))]
        return pa.RecordBatch.from_arrays([*docs.flatten(), *[pa.array(v) for v in sums]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: dict[int, list[bytes]] = {}
        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["docs"]).to_pylist()):
                if row["tokens"] is None:
                    data.setdefault(row["level"], []).append(row["data"])
                else:
                    yield score(row, data, batch["docs"][i].values)
                    data = {}

    return run


def scores(docs: DataFrame, train_col: str, keys: list[str], text_col: str = "text", order: int = ORDER,
           block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Key columns, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-one
    unigrams), ``score`` (log10) and ``perplexity`` of every row, under the model
    of those where ``train_col`` is true."""
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = docs.sparkSession
    written = blocks(docs, keys, text_col, train_col, block_tokens)
    counted = count(written, order, shard_tokens)
    rows = written.select("block", F.lit(order + 1).alias("level"), F.lit(0).cast("bigint").alias("shard"),
                          F.lit(None).cast("binary").alias("data"), "tokens", "lengths", "train", "docs")
    none = [F.lit(None).cast(written.schema[c].dataType).alias(c) for c in ("tokens", "lengths", "train", "docs")]
    for level, path in counted.paths.items():
        replies = spark.read.schema(_OUT_DDL).parquet(path).where(F.col("kind") == REPLY)
        rows = rows.unionByName(replies.select(F.col("target").alias("block"), F.lit(level).alias("level"), "shard", "data", *none))
    named = StructType([docs.schema[k] for k in keys])
    results = [("n_tokens", pa.int64(), "bigint"), ("n_known", pa.int64(), "bigint"),
               ("base_score", pa.float64(), "double"), ("score", pa.float64(), "double")]
    schema = pa.schema([*[(f"k{i}", to_arrow_type(f.dataType)) for i, f in enumerate(named)],
                        *[(n, t) for n, t, _ in results]])
    ddl = ", ".join([*[f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(named)], *[f"{n} {t}" for n, _, t in results]])
    found = (rows.repartition("block").sortWithinPartitions("block", "level", "shard")
             .mapInArrow(_scores(order, counted, schema), ddl))
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "n_tokens", "n_known",
                        F.lit(counted.totals[1][6]).cast("bigint").alias("train_tokens"), "base_score", "score",
                        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def score_digest(docs: DataFrame) -> DataFrame:
    """The rows of the registered query."""
    held = docs.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "text").withColumn("train", ~F.col("held_out"))
    found = scores(held, "train", ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens",
                        F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"),
                        F.round("perplexity", 3).alias("perplexity"))


def _discount_sql(counts: str) -> str:
    """Discounts of a level from the counts ``n`` of its grams."""
    y = "t1 / (t1 + 2 * t2)"

    def one(k):
        return (f"case when least(t1, t2, t3) = 0 then {_GAPS[k - 1]} else "
                f"greatest(least({k} - {k + 1} * ({y}) * t{k + 1} / t{k}, {k}), 0) end as d{k}")

    tallies = ", ".join(f"cast(count(*) filter (n = {k}) as double) as t{k}" for k in (1, 2, 3, 4))
    return f"select {one(1)}, {one(2)}, {one(3)} from (select {tallies} from {counts})"


# The begin and the end mark hold a blank, which no word does.
ORACLE_SQL = f"""
with d as (
  select row_number() over () as k, doc_id, {crc_sql('doc_id')} % 7 = 2 as held_out,
    list_concat([' <s>'], regexp_extract_all({lower_sql('text')}, '[^\x20\x09-\x0D]+'), [' </s>']) as w from documents),
t as (select k, held_out, w[i] as u, w[i + 1] as w from (select *, unnest(range(1, len(w))) as i from d)),
words as (select w, count(*) as n from t where not held_out group by w),
pairs as (select u, w, count(*) as n from t where not held_out group by u, w),
continued as (select w, count(*) as n from pairs group by w),
sizes as (select coalesce(sum(n), 0) as tokens, count(*) as types from words),
low as ({_discount_sql('continued')}),
high as ({_discount_sql('pairs')}),
lowest as (
  select coalesce(sum(n), 0) as total,
    coalesce((any_value(d1) * count(*) filter (n = 1) + any_value(d2) * count(*) filter (n = 2)
      + any_value(d3) * count(*) filter (n > 2)) / nullif(sum(n), 0), 1) as spare from continued, low),
contexts as (
  select u, sum(n) as total, any_value(d1) * count(*) filter (n = 1) + any_value(d2) * count(*) filter (n = 2)
    + any_value(d3) * count(*) filter (n > 2) as spare from pairs, high group by u),
p as (
  select t.k, words.n as known, log10((coalesce(words.n, 0) + 1) / (tokens + types + 1)) as base,
    case when continued.n is null then 0 else
      (continued.n - case continued.n when 1 then low.d1 when 2 then low.d2 else low.d3 end) / lowest.total end
      + lowest.spare / (types + 1) as p1,
    contexts.total as total, contexts.spare as spare,
    case when pairs.n is null then 0 else
      pairs.n - case pairs.n when 1 then high.d1 when 2 then high.d2 else high.d3 end end as left_over
  from t left join words on words.w = t.w left join continued on continued.w = t.w
    left join pairs on pairs.u = t.u and pairs.w = t.w left join contexts on contexts.u = t.u, sizes, low, high, lowest),
s as (
  select k, count(*) as n_tokens, count(known) as n_known, sum(base) as base_score,
    sum(log10(case when total is null then p1 else (left_over + spare * p1) / total end)) as score from p group by k)
select doc_id, held_out, n_tokens, n_known, cast(tokens as bigint) as train_tokens, round(base_score, 6) as base_score,
  round(score, 6) as score, round(power(10.0, -score / n_tokens), 3) as perplexity
from d join s using (k), sizes
"""
