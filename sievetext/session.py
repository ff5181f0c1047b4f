"""Spark session helpers and the shared scratch folder.

Library code never builds its own session; it takes the caller's.  The only
place where a folder is chosen by us is :func:`scratch_root`, and only when the
cluster has not named a checkpoint directory (local runs and tests).
"""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_WRITTEN: list[str] = []
#: Most partitions that a size estimate may ask for.
MAX_PARTITIONS = 200_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "sievetext", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (no UI, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written tables and checkpoints.

    Uses the checkpoint directory the cluster names (``spark.checkpoint.dir``
    or one set on the context).  Where none is set, a local master (driver and
    executors are one process) gets a fresh folder that goes when Python ends;
    on any other master that is an error: its machines share no such folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        try:
            named = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            named = None
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="sievetext-ckpt-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared scratch folder."""
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables that this Python process has written, once no
    DataFrame over them is needed any more; returns their number."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    n = 0
    while _WRITTEN:
        path = hadoop(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def written_mark() -> int:
    """The number of scratch paths so far, for :func:`drop_unread`."""
    return len(_WRITTEN)


def drop_unread(spark: SparkSession, since: int, *frames) -> int:
    """Delete the scratch tables that were written after the mark ``since`` and that
    no plan of ``frames`` reads, and let Spark clear the shuffle files of plans
    that are no longer held; returns the number of deleted tables.  For callers
    who hold all that was made since the mark and go on with ``frames`` only."""
    read = {part for frame in frames for name in frame.inputFiles() for part in name.split("/")}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    gone = [path for path in _WRITTEN[since:] if path.rsplit("/", 1)[1] not in read]
    for name in gone:
        path = hadoop(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(name)
    gc.collect()  # Python's handles on the plans first, then the plans
    spark._jvm.System.gc()
    return len(gone)


def materialize(df, name: str):
    """Write ``df`` as parquet under the shared scratch folder and read it back.

    Cuts the lineage (a lost executor re-reads the table instead of re-running
    the plan), lets several consumers share one computation, and gives later
    joins real size statistics.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def input_partitions(df) -> int | None:
    """Number of input-sized partitions of a plan, from the estimated size of
    the tables it reads and ``spark.sql.files.maxPartitionBytes``: never runs a
    job; ``None`` where the session cannot tell."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(leaves.apply(i).stats().sizeInBytes().toString()) for i in range(leaves.size())]
        size = sum(n for n in sizes if n < 1 << 60)  # more means "unknown"
        part = int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    except Exception:  # noqa: BLE001 - e.g. sessions without a local JVM
        return None
    return max(1, min(-(-size // max(1, part)), MAX_PARTITIONS))


def scan_partitions(df) -> int | None:
    """Partition count of a plan without an exchange (a scan and row-local
    steps); ``None`` for any other plan, because asking would run its stages."""
    try:
        if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
            return None
        return df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. sessions without RDD access
        return None


def spread(df, *keys: str):
    """Hash-repartition a source on ``keys`` only when its scan has fewer
    partitions than the cluster's parallelism (a file with one row group is
    read by one task).  Large inputs of many files are left untouched."""
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    have = scan_partitions(df)
    if have is None or have >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session that was started
    outside the repository and without an installed copy (``pip install .`` or
    ``spark-submit --py-files`` do the same)."""
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="sievetext-pkg-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    packed = shutil.make_archive(os.path.join(folder, "sievetext"), "zip",
                                 root_dir=os.path.dirname(here), base_dir=os.path.basename(here))
    spark.sparkContext.addPyFile(packed)


def setting(spark: SparkSession, name: str, default: int) -> int:
    """An integer knob from the session: ``spark.sievetext.<name>``."""
    try:
        value = spark.conf.get(f"spark.sievetext.{name}", None)
    except Exception:  # noqa: BLE001
        value = None
    return int(value) if value not in (None, "") else int(default)
