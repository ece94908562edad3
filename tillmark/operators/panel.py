"""One panel of all stores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

PANEL_KEY = ("store_id", "date")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, by column name."""
    if not frames:
        raise ValueError("nothing to combine: no input tables")
    return reduce(lambda a, b: a.unionByName(b), frames)


def keep_first(
    df: DataFrame,
    keys: Sequence[str] = PANEL_KEY,
    order_col: str | None = None,
    count_col: str | None = None,
) -> DataFrame:
    """One row per key.

    With ``order_col`` it is the row that comes first in that order, without it the
    one whose remaining columns come first.  Either is a map-side minimum rather
    than a ranking, so that many copies of one key never meet in one task.
    ``count_col`` adds how many rows shared the key.
    """
    order = [] if order_col is None else [order_col]
    rest = [c for c in df.columns if c not in (*keys, *order)]
    counts = [] if count_col is None else [F.count(F.lit(1)).alias(count_col)]
    if not order and not rest:
        return df.groupBy(*keys).agg(*counts) if counts else df.dropDuplicates(list(keys))
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__first"), *counts)
    columns = [F.col(c) if c in keys else F.col(f"__first.{c}") for c in df.columns]
    return first.select(*columns, *([] if count_col is None else [count_col]))


def duplicate_keys(df: DataFrame, keys: Sequence[str] = PANEL_KEY) -> DataFrame:
    """Keys that occur more than once, with how often."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.filter(F.col("row_count") > 1)
