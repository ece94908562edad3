"""Tables that a computation writes down for itself, in a folder that all machines share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_run: ContextVar[str | None] = ContextVar("run_folder", default=None)
# application -> its own folder, on a single machine without a shared one
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The open :func:`run_folder`, else the folder named by ``spark.checkpoint.dir``.

    On a single machine without the setting it is a temporary folder, removed at exit.
    A cluster without it is an error: its machines share no temporary folder.
    """
    named = _run.get() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="tillmark-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


@contextlib.contextmanager
def run_folder(spark: SparkSession, parent: str | None = None) -> Iterator[str]:
    """A folder of its own for all tables written inside; removed with them afterwards.

    Frames made inside may read these tables, so use them up before it closes.
    """
    path = f"{(parent or shared_dir(spark)).rstrip('/')}/run-{uuid.uuid4().hex}"
    before = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(before)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(where):
            fs.delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: no lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, metrics: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` with aggregates that whatever action runs on it takes along."""
    seen = Observation(f"seen-{uuid.uuid4().hex}")
    return df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), seen


def stored_counted(df: DataFrame, name: str, metrics: Mapping[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """:func:`stored` with aggregates of the rows, taken while they are written."""
    watched, seen = observed(df, metrics)
    return stored(watched, name), seen.get
