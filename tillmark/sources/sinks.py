"""Sinks of the three jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from tillmark.functions.calendar import month_timestamp
from tillmark.sources.scratch import observed

Accept = Callable[[dict[str, int]], None]


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write a table and return it as read back, so later steps do not recompute it."""
    df.write.format(fmt).mode("overwrite").save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path)


def write_counted(
    df: DataFrame, path: str, metrics: Mapping[str, Column], fmt: str = "parquet"
) -> tuple[DataFrame, dict[str, int]]:
    """:func:`write_table` with aggregates of the rows, taken while they are written."""
    watched, seen = observed(df, metrics)
    return write_table(watched, path, fmt), seen.get


def publish(df: DataFrame, path: str, seen: Observation, accept: Accept, fmt: str = "parquet") -> DataFrame:
    """Write, audit, publish.

    Rows go to a folder beside ``path``, and ``seen`` takes its aggregates on the way.
    ``accept`` looks at these and raises if the table must not appear; then nothing at
    ``path`` has changed.  Otherwise the folder takes the place of ``path``.
    """
    spark, staged = df.sparkSession, f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        df.write.format(fmt).save(staged)
        accept(seen.get)
        _move(spark, staged, path)
    finally:
        _remove(spark, staged)
    return spark.read.format(fmt).schema(df.schema).load(path)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _remove(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    if fs.exists(where):
        fs.delete(where, True)


def _move(spark: SparkSession, source: str, target: str) -> None:
    """``source`` becomes ``target``; what was there is set aside until then."""
    fs, new = _file_system(spark, source)
    place = _file_system(spark, target)[1]
    old = _file_system(spark, f"{source}-replaced")[1]
    held = fs.exists(place)
    if held and not fs.rename(place, old):
        raise OSError(f"cannot set {target} aside")
    if not fs.rename(new, place):
        if held:
            fs.rename(old, place)
        raise OSError(f"cannot publish {target}")
    if held:
        fs.delete(old, True)


def with_timestamps(df: DataFrame, wanted: bool = True) -> DataFrame:
    """The month as a timestamp, for readers that expect one; the jobs' index sinks use it."""
    return df.withColumn("date", month_timestamp(df["date"])) if wanted else df


def write_index_per_store(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per store.  Stores without rows in ``df`` keep the folder they have."""
    placed = df.repartition("store_id").write.mode("overwrite").partitionBy("store_id")
    placed.option("partitionOverwriteMode", "dynamic").format(fmt).save(path)


def write_review_sheet(df: DataFrame, path: str) -> None:
    """Candidate list for the reviewers: CSV with a header, in the given order."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
