"""Left join whose keys treat NULL as a value, for tables keyed on nullable columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def null_safe_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on ``keys`` with NULL matching NULL.

    ``<=>`` stays an equi-join for Catalyst, so the usual broadcast / sort-merge
    choice and AQE's skew splitting both still apply.
    """
    hidden = {k: f"__right_{k}" for k in keys}
    renamed = right.withColumnsRenamed(hidden)
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(h)) for k, h in hidden.items()]
    )
    return left.join(renamed, condition, "left").drop(*hidden.values())
