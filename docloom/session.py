"""Session helpers: one place for session settings, shared storage and code shipping."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from pathlib import Path
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession

_OWN_SHARED: dict[str, str] = {}
_SHIPPED: set[str] = set()
_SCRATCH: ContextVar[tuple[str, ...]] = ContextVar("docloom-scratch", default=())


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests, a laptop) is a folder of our own used; it is the
    same for all calls of the application and goes with the process. On a cluster without the setting this raises: each
    executor would write to a disk of its own, and later reads would miss those files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (the master is {master})")
    app = spark.sparkContext.applicationId
    if app not in _OWN_SHARED:
        folder = tempfile.mkdtemp(prefix="docloom-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN_SHARED[app] = "file://" + folder
    return _OWN_SHARED[app]


def run_dir(spark: SparkSession) -> str:
    """The part of the shared folder that holds what this application writes between its steps."""
    return f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete what this application wrote between its steps. Results that are still lazy read from it: write them first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class scratch:
    """``with scratch(spark):`` everything that this thread writes between steps inside goes at its end."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.name = spark, uuid.uuid4().hex

    def __enter__(self) -> scratch:
        self.outer = _SCRATCH.set((*_SCRATCH.get(), self.name))
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([run_dir(self.spark), *_SCRATCH.get()]))
        _SCRATCH.reset(self.outer)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return "/".join([run_dir(spark), *_SCRATCH.get(), f"{label}-{uuid.uuid4().hex}"])


#: While we write, Spark deletes a write's shuffle files at its end instead of whenever the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITES, _WRITERS = Lock(), {}


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go at its end. The setting is as it was after the last thread has left."""
    app = spark.sparkContext.applicationId
    with _WRITES:
        n, before = _WRITERS.get(app) or (0, spark.conf.get(_CLEANUP, None))
        _WRITERS[app] = n + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _WRITES:
            n, before = _WRITERS[app]
            _WRITERS[app] = (n - 1, before) if n > 1 else None
            if n == 1:
                spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def kept(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written to the shared folder and read back; all else that it wrote there goes."""
    path = new_path(spark, label)
    with scratch(spark):
        made = make()
        with shuffles_dropped(spark):
            made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of what was written.

    This cuts lineage so that a lost executor costs a re-read rather than a re-computation, pins results that must
    not change between two uses, and gives the planner exact sizes: joins with what is small are broadcast by
    Spark's own size check and all others shuffle.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = new_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_dropped(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer tasks than there are cores, dealt out to all of them; any other scan as it is.

    A small file of one row group is read by one task, and so would be all that is done to its rows before a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


#: Rows that Spark hands to Python at once, unless the caller has set their number: long texts would else make batches
#: that neither side can hold.
BATCH_ROWS = 1024
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application, and bound the batches they get."""
    app = spark.sparkContext.applicationId
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="docloom-code-"), "docloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shipped(function: Callable[..., Column]) -> Callable[..., Column]:
    """A function that makes Columns with Python in them, and sends this package to the executors first."""

    @wraps(function)
    def made(*args: object, **kwargs: object) -> Column:
        ship_package(SparkSession.active())
        return function(*args, **kwargs)

    return made
