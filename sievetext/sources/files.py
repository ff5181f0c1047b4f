"""File sources and sinks.

Every reader declares its schema; nothing is inferred.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, scratch_root
from .splits import read_csv_split

LABELED_CSV_SCHEMA = T.StructType([T.StructField("label", T.StringType()),
                                   T.StructField("text", T.StringType())])

PREDICTIONS_SCHEMA = T.StructType([T.StructField("id", T.LongType()),
                                   T.StructField("actual_label", T.LongType()),
                                   T.StructField("predicted_label", T.LongType())])

_CSV_OPTS = dict(header=False, quote='"', escape='"', multiLine=True)
# A field is null only when it is empty and unquoted; a quoted "" is the empty
# string.  The reader's null token is therefore one that never appears.
_NO_NULL_TOKEN = "\u0000"
#: Texts to a folder, and the id that stands for none (Spark's).
FOLDER_TEXTS = 1_000
_NO_ID = "__HIVE_DEFAULT_PARTITION__"
#: Folders that the driver names to the tasks that list them.
_MOST_FOLDERS = 50_000
#: Bytes of text that a task reads before it hands them on.
READ_BYTES = 2 << 20


def write_csv(df: DataFrame, path: str) -> str:
    """Headerless CSV without an index column (S8).  Fields with separators,
    quotes or newlines are quoted (quotes doubled); empty strings are written
    as ``""``, nulls as nothing."""
    df.write.mode("overwrite").options(**_CSV_OPTS).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType = LABELED_CSV_SCHEMA,
             splittable: bool = False) -> DataFrame:
    """Headerless labelled CSV, columns in schema order (S1, S7); texts may span
    lines.  Empty quoted fields stay empty strings, empty unquoted ones are null.
    ``splittable`` reads a large file by many tasks (:mod:`.splits`); quotes within
    a field must then be doubled and the field quoted, as :func:`write_csv` does."""
    if splittable:
        return read_csv_split(spark, path, schema, {**_CSV_OPTS, "nullValue": _NO_NULL_TOKEN})
    return spark.read.schema(schema).options(**_CSV_OPTS, nullValue=_NO_NULL_TOKEN).csv(path)


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType = PREDICTIONS_SCHEMA,
              multi_line: bool = False) -> DataFrame:
    """Prediction table from JSON (S2): JSON lines, or with ``multi_line`` a
    file holding one array of records."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def write_text_folder(df: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> str:
    """One text per file (S6), its id in the path as ``<id_col>=<n>``; texts of one id
    that a task meets together are the lines of one file.

    On a file system of the machine or mounted there (``file:``) tasks write the files
    themselves, ``FOLDER_TEXTS`` to a folder: Hadoop's local file system starts a
    process for each permission that it sets, several for a text, and a folder per
    text takes as much disk as the text.  Elsewhere it is Spark's writer and a folder
    per id.  The texts appear under ``path`` when all are written.
    """
    rows = df.select(id_col, text_col)
    local = _local_path(df.sparkSession, path)
    if local is None or rows.schema[text_col].dataType != T.StringType():
        rows.write.mode("overwrite").partitionBy(id_col).text(path)
    else:
        _write_text_files(rows, local, id_col, text_col)
    return path


def _local_path(spark: SparkSession, path: str) -> str | None:
    """The path on the machine's own or mounted file system, ``None`` on any other."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _write_text_files(rows: DataFrame, path: str, id_col: str, text_col: str) -> None:
    """``path/<task>/<k>/<id_col>=<n>.txt``.  Every attempt of a task writes to a folder
    of its own; those of the attempts that Spark counts are kept."""
    shown = F.coalesce(F.nullif(F.col(id_col).cast("string"), F.lit("")), F.lit(_NO_ID))
    ready = rows.sortWithinPartitions(id_col).select(shown.alias("id"), F.col(text_col).cast("binary").alias("text"))
    base = f"{os.path.dirname(path)}/.{os.path.basename(path)}-{uuid.uuid4().hex[:12]}"
    head = _escaped(id_col)

    def run(batches):
        task = TaskContext.get()
        own = f"{base}/_{task.partitionId()}-{task.taskAttemptId()}"
        now, out, n = None, None, 0
        try:
            for rb in batches:
                for ident, text in zip(rb.column("id").to_pylist(), rb.column("text").to_pylist(), strict=True):
                    if ident != now:
                        if out is not None:
                            out.close()
                        folder = f"{own}/{n // FOLDER_TEXTS:06d}"
                        if n % FOLDER_TEXTS == 0:
                            os.makedirs(folder)
                        now, out, n = ident, open(f"{folder}/{head}={_escaped(ident)}.txt", "wb"), n + 1
                    out.write((text or b"") + b"\n")
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.RecordBatch.from_pydict({"task": [task.partitionId()], "folder": [own]})

    os.makedirs(base)
    try:
        for row in ready.mapInArrow(run, "task long, folder string").collect():
            os.rename(row["folder"], f"{base}/part-{row['task']:05d}")
        for left in os.listdir(base):
            if left.startswith("_"):  # of attempts that failed or came too late
                shutil.rmtree(f"{base}/{left}", ignore_errors=True)
        open(f"{base}/_SUCCESS", "wb").close()
        if os.path.isdir(path):
            shutil.rmtree(path)
        os.rename(base, path)
    except BaseException:
        shutil.rmtree(base, ignore_errors=True)
        raise


def _escaped(name: str) -> str:
    """A value as Spark writes it in the name of a folder."""
    return re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", name)


def write_text_records(df: DataFrame, path: str, files: int, id_col: str = "id",
                       text_col: str = "text") -> str:
    """Many texts in ``files`` files, a JSON record each: a folder per text, as
    :func:`write_text_folder` makes, costs a file and a directory per row.  Rows are
    dealt by a hash of both columns; an empty text stays apart from a null one."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows.repartition(files, "id", "text").write.mode("overwrite").json(path)
    return path


def read_text_records(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """``id, text`` of :func:`write_text_records`; a record is one line, so files split."""
    return spark.read.schema(f"id {id_type}, text string").json(path)


def read_text_folder(spark: SparkSession, path: str, id_col: str = "id") -> DataFrame:
    """Every file under ``path`` as one text (S6): ``path, id, text``.

    ``id`` is parsed from a ``<id_col>=<n>`` folder or file name when present.  The
    text writer ends each file with a newline, which is removed.

    Spark's reader holds an entry for every file in the driver.  Folders on a file
    system of the machine or mounted there (``file:``) are therefore listed and read by
    the tasks, with the rows of Spark's reader; patterns, single files and folders with
    compressed files, and other file systems, are left to Spark.  Small files share
    read tasks: as many as their size asks for, but four a core at least.
    """
    raw = _read_by_tasks(spark, path)
    by_spark = raw is None
    if by_spark:
        raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.col("_metadata.file_path"))
    text = F.when(F.col("value").endswith("\n"),
                  F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    ident = F.regexp_extract("path", f"{id_col}=([0-9]+)", 1)
    texts = raw.select("path", F.when(ident != "", ident.cast("long")).alias(id_col), text.alias("text"))
    if not by_spark:
        return texts
    try:
        size = int(str(raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return texts.coalesce(_read_tasks(spark, size))
    except Exception:  # noqa: BLE001 - e.g. sessions without a local JVM
        return texts


def _read_tasks(spark: SparkSession, size: int) -> int:
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(-(-size // max(1, most)), 4 * spark.sparkContext.defaultParallelism)


def _read_by_tasks(spark: SparkSession, path: str) -> DataFrame | None:
    """``path, value`` of every file under a local or mounted folder, or ``None`` where
    Spark's reader is needed.  The files are listed once, to a written table."""
    try:
        local = _local_path(spark, path)
        if local is None or re.search(r"[][{}*?\\]", path) or not os.path.isdir(local) or any(
                spark.conf.get(f"spark.sql.files.ignore{k}Files") == "true" for k in ("Missing", "Corrupt")):
            return None
        scratch_root(spark)
        packed = _codec_endings(spark)
    except Exception:  # noqa: BLE001 - e.g. sessions without a local JVM or a shared folder
        return None
    cores = spark.sparkContext.defaultParallelism
    folders = _folders(local, 4 * cores)
    listing = spark.createDataFrame(folders, "folder string, deep boolean").repartition(min(len(folders), 4 * cores))
    files = materialize(listing.mapInArrow(_list_files, "file string, size long"), "text-files")
    ended = F.lit(False)
    for ending in packed:
        ended = ended | F.lower("file").endswith(ending)
    n, size, any_packed = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.max(ended)).first()
    if any_packed:
        return None
    tasks = max(1, min(n, _read_tasks(spark, size)))
    read = files.select("file").repartition(tasks, "file").mapInArrow(_read_files, "path string, value binary")
    return read.select("path", F.col("value").cast("string").alias("value"))


def _codec_endings(spark: SparkSession) -> list[str]:
    """Endings of the files that Hadoop unpacks while it reads them."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    kinds = hadoop.io.compress.CompressionCodecFactory.getCodecClasses(conf)
    return sorted({hadoop.util.ReflectionUtils.newInstance(kinds.get(i), conf).getDefaultExtension().lower()
                   for i in range(kinds.size())})


def _hidden(name: str, folder: bool) -> bool:
    """Whether Spark's readers leave out files or folders of this name."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _folders(top: str, least: int) -> list[tuple[str, bool]]:
    """Folders for tasks to list, with (True) or without what lies below them: at
    least so many where the tree has them, and no more than :data:`_MOST_FOLDERS`."""
    deep, done = [top], []
    while deep and len(deep) < least:
        below = []
        for folder in deep:
            with os.scandir(folder) as entries:
                for e in entries:
                    if e.is_dir() and not _hidden(e.name, True):
                        below.append(e.path)
                        if len(below) > _MOST_FOLDERS:
                            return [(f, False) for f in done] + [(f, True) for f in deep]
        done, deep = done + deep, below
    return [(f, False) for f in done] + [(f, True) for f in deep]


def _list_files(batches):
    """The files with content in or below the given folders."""
    def out(found):
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()),
                                           pa.array([n for _, n in found], pa.int64())], ["file", "size"])

    found = []
    for rb in batches:
        for folder, deep in zip(rb.column("folder").to_pylist(), rb.column("deep").to_pylist(), strict=True):
            left = [folder]
            while left:
                with os.scandir(left.pop()) as entries:
                    for e in entries:
                        if e.is_dir():
                            if deep and not _hidden(e.name, True):
                                left.append(e.path)
                        elif not _hidden(e.name, False):
                            try:
                                size = e.stat().st_size
                            except FileNotFoundError:  # gone meanwhile, or a link to nowhere
                                continue
                            if size:
                                found.append((e.path, size))
                            if len(found) >= 10_000:
                                yield out(found)
                                found = []
    yield out(found)


def _read_files(batches):
    def out(paths, texts):
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], ["path", "value"])

    paths, texts, held = [], [], 0
    for rb in batches:
        for name in rb.column("file").to_pylist():
            with open(name, "rb") as f:
                texts.append(f.read())
            paths.append(f"file:{_quoted(name)}")
            held += len(texts[-1])
            if held > READ_BYTES or len(texts) >= 10_000:
                yield out(paths, texts)
                paths, texts, held = [], [], 0
    yield out(paths, texts)


def _quoted(name: str) -> str:
    """A path as it stands in a URI of Java's."""
    return re.sub("[\x00-\x20\x7f-\xa0\"#%<>?\\[\\\\\\]^`{|}\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]",
                  lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), name)


def write_parquet(df: DataFrame, path: str) -> str:
    """Save prepared data."""
    df.write.mode("overwrite").parquet(path)
    return path


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
