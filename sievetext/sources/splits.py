"""One large file read by many tasks although its records span lines: CSV with
line breaks in quoted fields (S1, S7), and JSON files that are one array (S2).

Spark's own readers give such a file to one task, because where a record begins
depends on all the text before it.  Here the file is read as plain chunks, which
splits anywhere (CSV: lines; JSON: what lies between closing braces), in passes:

1. every input split is summed up as a small function from the state at its
   begin to the state at its end (CSV: quotes open or not; JSON: inside a
   string or not, and the change of nesting depth for either);
2. the functions are combined along each file, one narrow row per split, which
   gives every split's state at its begin;
3. with it, a task cuts its splits into records.  Text before the first and
   behind the last end of a record in a split is a fragment; the fragments of
   one record (of two splits mostly) meet in a small aggregate.

The states that are broadcast in pass 3 are 24 bytes a split.  Fields are parsed
by ``from_csv`` / ``from_json``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

_ESCAPED = re.compile(r"\\.", re.DOTALL)
_STRING = re.compile(r'"[^"]*"')


class QuotedLines:
    """CSV: a record ends with a line outside quotes.  A quote character inside a
    field is doubled, and the field quoted, so the parity of quotes tells."""

    separator, joint = "\n", "\n"

    def summary(self, chunk: str) -> tuple[int, int, int]:
        """Parity, and the change of depth from a begin outside / inside quotes."""
        return chunk.count('"') & 1, 0, 0

    def ends(self, inside: bool, depth: int) -> bool:
        return not inside


class ArrayItems:
    """A JSON array of objects: a record ends with a closing brace, outside
    strings, that leads back to the depth of the array's items."""

    separator, joint = "}", "}"

    def summary(self, chunk: str) -> tuple[int, int, int]:
        plain = _ESCAPED.sub("", chunk) if "\\" in chunk else chunk
        quotes = plain.count('"')
        outside = _STRING.sub("", plain) if quotes else plain
        if quotes & 1:
            outside = outside.partition('"')[0]
        inside = plain.partition('"')[2] if quotes else ""
        inside = _STRING.sub("", inside)
        if quotes and not quotes & 1:
            inside = inside.partition('"')[0]

        def depth(text: str, closed: bool) -> int:
            # The brace that ends the chunk counts where it is outside strings.
            return text.count("{") + text.count("[") - text.count("]") - int(closed)

        return quotes & 1, depth(outside, not quotes & 1), depth(inside, bool(quotes & 1))

    def ends(self, inside: bool, depth: int) -> bool:
        return not inside and depth == 1


def _chunks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    raw = spark.read.option("lineSep", separator).text(path)
    return raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                      "value")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[str]]]:
    """``(file, start)`` and chunks, split by split in order; a long split comes in parts."""
    for rb in batches:
        if not rb.num_rows:
            continue
        file, start = rb.column("file").to_numpy(), rb.column("start").to_numpy()
        edge = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
        values = rb.column("value").to_pylist()
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(values)], strict=True):
            yield (int(file[a]), int(start[a])), values[a:b]


def _states(chunks: DataFrame, form) -> dict[tuple[int, int], tuple[bool, int]]:
    """State at the begin of every split (passes 1 and 2)."""
    def run(batches):
        now, parity, depths = None, 0, [0, 0]

        def row():
            return pa.RecordBatch.from_pydict({"file": [now[0]], "start": [now[1]], "parity": [parity],
                                               "outside": [depths[0]], "inside": [depths[1]]})

        for key, values in _by_split(batches):
            if now is not None and key != now:
                yield row()
                parity, depths = 0, [0, 0]
            now = key
            for v in values:
                p, *change = form.summary(v)
                for s in (0, 1):  # begun outside, inside
                    depths[s] += change[s ^ parity]
                parity ^= p
        if now is not None:
            yield row()

    each = chunks.mapInArrow(run, "file bigint, start bigint, parity bigint, outside bigint, inside bigint")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    found = materialize(each, "split-functions").withColumn(
        "open", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2 == 1)
    found = found.withColumn("change", F.when(F.col("open"), F.col("inside")).otherwise(F.col("outside"))).withColumn(
        "depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    rows = found.select("file", "start", "open", "depth").toArrow().to_pylist()
    return {(r["file"], r["start"]): (r["open"], r["depth"]) for r in rows}


def split_records(spark: SparkSession, path: str, form) -> DataFrame:
    """``record``: the text of every record under ``path``, one row each."""
    chunks = _chunks(spark, path, form.separator)
    states = spark.sparkContext.broadcast(_states(chunks, form))
    schema = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("kind", pa.int32()), ("record", pa.string())])

    def run(batches):
        begun = states.value
        now, held, inside, depth, met = None, [], False, 0, False

        def out(rows):
            return pa.RecordBatch.from_pylist(
                [{"file": now[0], "start": now[1], "kind": k, "record": r} for k, r in rows], schema=schema)

        for key, values in _by_split(batches):
            rows = []
            if key != now:
                if now is not None:
                    # kind 0: whole; 1: ends the split's first record; 2: open at its end; 3: neither
                    yield out([(2 if met else 3, form.joint.join(held))] if held else [])
                now, held, met = key, [], False
                inside, depth = begun[key]
            for v in values:
                p, *change = form.summary(v)
                depth += change[inside]
                inside ^= bool(p)
                held.append(v)
                if form.ends(inside, depth):
                    # The joint that ends the last chunk belongs to the record.
                    rows.append((0 if met else 1, form.joint.join(held) + (form.joint if form.joint == "}" else "")))
                    held, met = [], True
            if rows:
                yield out(rows)
        if now is not None and held:
            yield out([(2 if met else 3, form.joint.join(held))])

    cut = materialize(chunks.mapInArrow(run, "file bigint, start bigint, kind int, record string"), "records")
    parts = cut.where(F.col("kind") > 0)
    # The n-th end in a file closes the n-th group of fragments.
    ends = parts.groupBy("file", "start").agg(F.max(F.when(F.col("kind") == 1, 1).otherwise(0)).alias("end"))
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("group", F.coalesce(F.sum("end").over(order), F.lit(0)))
    placed = parts.join(ends, ["file", "start"]).withColumn(
        "group", F.col("group") + F.when(F.col("kind") == 2, F.col("end")).otherwise(0))
    glued = placed.groupBy("file", "group").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("p")).select(
        F.array_join(F.col("p.record"), form.joint).alias("record"))
    return cut.where(F.col("kind") == 0).select("record").unionByName(glued)


def read_csv_split(spark: SparkSession, path: str, schema: T.StructType, options: dict) -> DataFrame:
    """Headerless CSV whose quoted fields may span lines, several tasks a file."""
    line = F.regexp_replace("record", "\r$", "")
    records = split_records(spark, path, QuotedLines()).select(line.alias("record")).where(F.col("record") != "")
    opts = {k: str(v) for k, v in options.items() if k not in ("header", "multiLine")}
    return records.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), opts).alias("r")).select("r.*")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON files that hold one array of objects each, several tasks a file."""
    item = F.regexp_extract("record", r"(?s)^[\s,\[\]]*(\{.*\})", 1)
    records = split_records(spark, path, ArrayItems()).select(item.alias("record")).where(F.col("record") != "")
    return records.select(F.from_json("record", schema).alias("r")).select("r.*")


def write_json_array(df: DataFrame, path: str) -> str:
    """One JSON array of the rows per written file."""
    def run(batches):
        first = True
        for rb in batches:
            lines = []
            for v in rb.column("value").to_pylist():
                lines.append(("[" if first else ",") + v)
                first = False
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ["[]" if first else "]"]})

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(run, "value string").write.mode(
        "overwrite").text(path)
    return path
