"""Session helpers: a local session for tests and the bench, and lineage cuts.

The library never creates a session itself; operators use the caller's.
"""

from __future__ import annotations

import contextlib
import contextvars
import threading
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: str | int = "*", partitions: int = 8, app: str = "basketry",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A local[N] session configured like the tests and bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``,
    or the folder set with ``SparkContext.setCheckpointDir``.

    Raises if there is none. The library never falls back to a folder of
    one machine: on a cluster the other executors could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = configured or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError(
            "no folder for intermediate tables: set spark.checkpoint.dir (or call "
            "sparkContext.setCheckpointDir) to a folder that the driver and all executors share")
    return folder


_run: contextvars.ContextVar[str | None] = contextvars.ContextVar("basketry_run", default=None)


@contextlib.contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """While it is open, this thread's intermediate tables go below one new folder, which is removed when it closes.

    Write or collect results inside: a result that has not been computed
    still reads the tables::

        with run_folder(spark):
            rfm_segmentation(orders).write.parquet(out)
    """
    folder = f"{checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    token = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, or that of the open run."""
    return f"{(_run.get() or checkpoint_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once as a Parquet table in the shared folder.

    Cuts the lineage: what reads the table several times does not compute
    it again, and a lost executor costs only the tasks that ran on it. The
    shuffle files of the write go with it. The table stays until the folder
    is cleared, or the ``run_folder`` that is open is closed.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with _cleaning_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_lock = threading.Lock()
#: sessions that are writing: how many writes, and the setting before the first of them
_writes: dict[int, tuple[int, str]] = {}


@contextlib.contextmanager
def _cleaning_up(spark: SparkSession) -> Iterator[None]:
    """While a write runs, shuffle files go with their query; the session's own setting is back after the last
    of the writes that its threads run at a time."""
    key = id(spark)
    with _lock:
        running, before = _writes.get(key, (0, None))
        if not running:
            before = spark.conf.get(_CLEAN_UP)
            spark.conf.set(_CLEAN_UP, "true")
        _writes[key] = (running + 1, before)
    try:
        yield
    finally:
        with _lock:
            running, before = _writes.pop(key)
            if running > 1:
                _writes[key] = (running - 1, before)
            else:
                spark.conf.set(_CLEAN_UP, before)


def stored_together(frames: list[tuple[DataFrame, str]]) -> list[DataFrame]:
    """``stored`` for tables that do not depend on each other, written at the same time."""
    if len(frames) < 2:
        return [stored(df, name) for df, name in frames]
    with ThreadPoolExecutor(len(frames)) as pool:
        # each thread sees the run folder of this one
        running = [pool.submit(contextvars.copy_context().run, stored, df, name) for df, name in frames]
        return [r.result() for r in running]
