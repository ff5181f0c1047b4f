"""Packed token-id matrices, written in binary.

Documents are encoded, cut into windows without loss and packed best-fit
decreasing (a segment tree over remaining capacities, see ``packing``).  Each
writing task numbers its pieces of every length, so a piece's rank needs only
the counts per (length, task): the ids are written once and move once, to their
matrix of ``rows`` consecutive windows, which is written as one row with

* ``ids``: little-endian uint32, ``n_rows`` x ``window``, padded with ``pad_id``;
* ``cu_seqlens``: cumulative segment lengths of all its windows, from 0, one
  list of ``n_rows`` runs; ``row_segments`` has the number of segments per row;
* ``position_resets``: where in a row each segment starts, so position ids
  count from 0 there; ``doc_starts`` has the segment's place in its document,
  and a list per key column (``doc_id``: ``doc_ids``) says which document that is.

Spark's writer commits whole task outputs, so a lost executor leaves no half
matrix behind.  Defined cases: as for packing; an empty table writes no matrix.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import scratch_path
from .common import small_batches
from .packing import END_ID, WINDOW, cut, plan_ranks, tokenizer_path, worker_encoder

ROWS = 64
PAD_ID = 0
#: Rows of (length, task) counts that may be broadcast (24 bytes each).
MAX_BROADCAST = 1_000_000

_INTS = pa.list_(pa.int32())
_SCHEMA = pa.schema([
    ("matrix_id", pa.int64()), ("n_rows", pa.int32()), ("window", pa.int32()), ("ids", pa.binary()),
    ("row_segments", _INTS), ("cu_seqlens", _INTS), ("position_resets", _INTS),
    ("doc_starts", pa.list_(pa.int64()))])
_DDL = ("matrix_id bigint, n_rows int, window int, ids binary, row_segments array<int>, "
        "cu_seqlens array<int>, position_resets array<int>, doc_starts array<bigint>")


def _key_lists(schema: StructType, keys: list[str]) -> tuple[list[pa.Field], str]:
    """Arrow fields and DDL of the lists of key values, one per key column."""
    types = [schema[k].dataType for k in keys]
    return ([pa.field(f"{k}s", pa.list_(to_arrow_type(t))) for k, t in zip(keys, types, strict=True)],
            "".join(f", `{k}s` array<{t.simpleString()}>" for k, t in zip(keys, types, strict=True)))


def _matrix(matrix: int, segments: list[tuple], window: int, rows: int, pad_id: int,
            keys: list[str]) -> dict:
    """One matrix from its segments ``(sequence, offset, start, id width, ids,
    *key values)`` in order."""
    last = segments[-1][0] - matrix * rows
    ids = np.full((last + 1, window), pad_id, "<u4")
    row_segments, cu, resets, starts = [0] * (last + 1), [], [], []
    row = -1
    for sequence, offset, start, width, raw, *_ in segments:
        r = sequence - matrix * rows
        part = np.frombuffer(raw, f"<u{width}")
        ids[r, offset:offset + len(part)] = part
        if r != row:
            cu.append(0)
            row = r
        cu.append(offset + len(part))
        row_segments[r] += 1
        resets.append(offset)
        starts.append(start)
    return {"matrix_id": matrix, "n_rows": last + 1, "window": window, "ids": ids.tobytes(),
            "row_segments": row_segments, "cu_seqlens": cu, "position_resets": resets, "doc_starts": starts,
            **{f"{k}s": [v[5 + i] for v in segments] for i, k in enumerate(keys)}}


def matrices(placed: DataFrame, window: int = WINDOW, rows: int = ROWS, pad_id: int = PAD_ID,
             keys: list[str] | None = None) -> DataFrame:
    """Matrices of placed pieces with their ids, and their keys in the columns
    ``_key0``, ``_key1``, ..; a task holds one at a time."""
    keys = keys or ["doc_id"]
    own = [f"_key{i}" for i in range(len(keys))]
    named = StructType([type(f)(k, f.dataType) for k, f in zip(keys, (placed.schema[c] for c in own), strict=True)])
    fields, ddl = _key_lists(named, keys)
    schema = pa.schema([*_SCHEMA, *fields])
    moved = (placed.select((F.col("sequence_id") / rows).cast("long").alias("matrix"),
                           "sequence_id", "offset", "start", "width", "ids", *own)
             .repartition("matrix").sortWithinPartitions("matrix", "sequence_id", "offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, segments = None, []
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[0] != now:
                    if segments:
                        yield pa.RecordBatch.from_pylist(
                            [_matrix(now, segments, window, rows, pad_id, keys)], schema=schema)
                    now, segments = r[0], []
                segments.append(r[1:])
        if segments:
            yield pa.RecordBatch.from_pylist([_matrix(now, segments, window, rows, pad_id, keys)], schema=schema)

    return moved.mapInArrow(run, _DDL + ddl)


def ranked_pieces(docs: DataFrame, path: str, text_col: str = "text", window: int = WINDOW,
                  end_id: int = END_ID, keys: list[str] | None = None) -> DataFrame:
    """One row per piece: ``task``, the key columns as ``_key0``, ``_key1``, ..,
    ``start``, ``length``, ``rank`` among the task's pieces of that length, and
    the ids in ``width`` bytes each."""
    piece = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("rank", pa.int64()),
                       ("width", pa.int32()), ("ids", pa.binary())])

    @F.arrow_udf("array<struct<start:bigint,length:bigint,rank:bigint,width:int,ids:binary>>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder, seen = worker_encoder(path, end_id), Counter()
        width = 2 if len(coder.last) <= 1 << 16 else 4
        for texts in batches:
            rows = []
            for raw in coder.encode_all(texts.to_pylist()):
                ids = np.frombuffer(raw, "<u4").astype(f"<u{width}")
                parts = []
                for start, length in cut(len(ids), window):
                    parts.append({"start": start, "length": length, "rank": seen[length], "width": width,
                                  "ids": ids[start:start + length].tobytes()})
                    seen[length] += 1
                rows.append(parts)
            yield pa.array(rows, type=pa.list_(piece))

    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys or ["doc_id"])]
    coded = small_batches(docs).select(F.spark_partition_id().alias("task"), *named,
                                       encode(F.col(text_col).cast("string")).alias("_pieces"))
    own = [c for c in coded.columns if c != "_pieces"]
    return coded.select(*own, F.explode("_pieces").alias("_piece")).select(*own, "_piece.*")


def write_matrices(docs: DataFrame, out: str, path: str, text_col: str = "text",
                   window: int = WINDOW, rows: int = ROWS, end_id: int = END_ID,
                   pad_id: int = PAD_ID, max_broadcast: int = MAX_BROADCAST,
                   keys: list[str] | None = None) -> None:
    """Encode, cut, pack and write all documents to the folder ``out``; ``keys``
    (``doc_id``) tell the documents apart.

    The counts per (length, task) join by broadcast up to ``max_broadcast``
    rows, and by a shuffle of the pieces beyond."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "id-pieces")
    keys = keys or ["doc_id"]
    ranked_pieces(docs, path, text_col, window, end_id, keys).write.option("compression", "zstd").parquet(folder)
    cuts = spark.read.parquet(folder)
    starts, place = plan_ranks(cuts.groupBy("length", "task").agg(F.count("*").alias("_n")), "task", window)
    small = starts.count() <= max_broadcast
    placed = cuts.join(F.broadcast(starts) if small else starts, ["length", "task"]).withColumn(
        "_place", place("length", (F.col("rank") + F.col("_before")).cast("long")))
    own = [f"_key{i}" for i in range(len(keys))]
    packed = matrices(placed.select("start", "width", "ids", *own, "_place.*"), window, rows, pad_id, keys)
    packed.write.mode("overwrite").option("compression", "zstd").parquet(out)


def read_sequences(written: DataFrame) -> DataFrame:
    """One row per window of written matrices: its ids less the padding, segment
    lengths, position resets, the segments' places in their documents and the
    documents' keys."""
    lists = [f for f in written.schema if f.name not in _SCHEMA.names]
    keys = [f.name for f in lists]
    schema = pa.schema([("sequence_row", pa.int32()), ("matrix_id", pa.int64()), ("ids", pa.binary()),
                        ("cu_seqlens", _INTS), ("position_resets", _INTS), ("doc_starts", pa.list_(pa.int64())),
                        *((f.name, to_arrow_type(f.dataType)) for f in lists)])
    ddl = ("sequence_row int, matrix_id bigint, ids binary, cu_seqlens array<int>, "
           "position_resets array<int>, doc_starts array<bigint>"
           + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                ids = np.frombuffer(m["ids"], "<u4").reshape(m["n_rows"], m["window"])
                out, at, seg = [], 0, 0
                for r, n in enumerate(m["row_segments"]):
                    cu = m["cu_seqlens"][at:at + n + 1]
                    out.append({"sequence_row": r, "matrix_id": m["matrix_id"],
                                "ids": ids[r, :cu[-1]].tobytes(), "cu_seqlens": cu,
                                "position_resets": m["position_resets"][seg:seg + n],
                                "doc_starts": m["doc_starts"][seg:seg + n],
                                **{k: m[k][seg:seg + n] for k in keys}})
                    at, seg = at + n + 1, seg + n
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return written.mapInArrow(run, ddl)


def matrix_digest(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """The rows of the registered query, read back from the written matrices:
    one row per window."""
    spark = docs.sparkSession
    out = scratch_path(spark, "matrices")
    write_matrices(docs.select("doc_id", "text"), out, tokenizer_path(), rows=rows)
    found = read_sequences(spark.read.parquet(out))
    return found.select(
        (F.col("matrix_id") * rows + F.col("sequence_row")).alias("sequence_id"),
        F.element_at("cu_seqlens", -1).cast("long").alias("n_tokens"),
        F.size("position_resets").cast("long").alias("n_segments"),
        F.crc32("ids").alias("ids_crc32"),
        F.array_join(F.transform("cu_seqlens", lambda v: v.cast("string")), ",").alias("cu_seqlens"),
        F.array_join(F.transform("position_resets", lambda v: v.cast("string")), ",").alias("position_resets"),
        F.array_join(F.transform("doc_starts", lambda v: v.cast("string")), ",").alias("doc_starts"),
        F.array_join(F.transform("doc_ids", lambda v: v.cast("string")), ",", "null").alias("doc_ids"))
