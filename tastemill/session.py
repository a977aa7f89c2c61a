"""Session defaults and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Let AQE split a skewed join even where the next operator reuses its partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "tastemill", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Give a session made elsewhere the settings that the plans here rely on."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; fall back to a fresh one only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tastemill-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder, so later jobs survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of the `temporary` blocks that are open, the innermost last.
_open: list[str] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, so every executor can reach it."""
    ensure_checkpoint_dir(spark)
    base = _open[-1] if _open else spark.sparkContext.getCheckpointDir().rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What `stored` writes inside this block goes when it ends: write or collect results before."""
    base = scratch_folder(spark, "job")
    _open.append(base)
    try:
        yield
    finally:
        _open.remove(base)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Lets Spark delete the shuffles of a query when it ends, not when the driver's garbage collection gets to them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writers = [0, "false"]  # threads that write, and the setting before the first of them


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    with _lock:
        if not _writers[0]:
            _writers[1] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _writers[0] += 1
    try:
        yield
    finally:
        with _lock:
            _writers[0] -= 1
            if not _writers[0]:
                spark.conf.set(CLEANUP, _writers[1])


def stored(df: DataFrame, **options: object) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    For frames that several branches of a plan read: the work is done once, a lost executor costs
    a re-read, and each reader still scans only the columns it needs. The shuffles behind it are
    not read again, so they leave the disks as soon as it is written. `options` are those of the writer.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "stored")
    with _shuffles_dropped(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
