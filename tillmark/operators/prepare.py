"""Row-level preparation of the store x product x month table.

Everything here is a narrow projection or filter, so the two equality filters
reach the Parquet scan and unused columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, functions as F

from tillmark.functions.calendar import DEFAULT_FISCAL_CALENDAR, FiscalCalendar, month_start

if TYPE_CHECKING:
    from tillmark.operators.contracts import Contract

# The scan type that identifies a product, the default subcategory.
PRODUCT_SCAN_TYPE = "GTIN"
DEFAULT_SUBCATEGORY = "Vaping Products"

PERIOD_COLUMNS = {"fiscal": "fiscal_year", "calendar": "calendar_year"}
VALUE_COLUMNS = {"price": "unit_value_q", "qty": "quantity"}


def period_column(weight_basis: str) -> str:
    if weight_basis not in PERIOD_COLUMNS:
        raise ValueError(f"weight_basis must be 'fiscal' or 'calendar', not {weight_basis!r}")
    return PERIOD_COLUMNS[weight_basis]


def value_column(index_kind: str) -> str:
    if index_kind not in VALUE_COLUMNS:
        raise ValueError(f"index_kind must be 'price' or 'qty', not {index_kind!r}")
    return VALUE_COLUMNS[index_kind]


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise KeyError(f"the table lacks {absent}; it has {df.columns}")


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def prepare_store(
    df: DataFrame,
    calendar: FiscalCalendar = DEFAULT_FISCAL_CALENDAR,
    scan_type: str = PRODUCT_SCAN_TYPE,
) -> DataFrame:
    """Lower-case names, keep product scans, add ``date`` and ``fiscal_year``.

    The filter comes first, so an invalid month in a dropped row is harmless;
    in a kept row it raises.
    """
    df = lower_columns(df)
    require_columns(df, ["calendar_year", "calendar_month", "scan_type"])
    return (
        df.filter(F.col("scan_type") == scan_type)
        .withColumn("date", month_start(F.col("calendar_year"), F.col("calendar_month")))
        .withColumn("fiscal_year", calendar.fiscal_year(F.col("date")))
    )


def filter_subcategory(df: DataFrame, subcategory: str = DEFAULT_SUBCATEGORY) -> DataFrame:
    return df.filter(F.col("subcategory") == subcategory)


def limit_stores(df: DataFrame, n: int | None) -> DataFrame:
    """Rows of the ``n`` smallest store ids (dry run); ``None`` keeps everything.

    The id list is a top-n over a partially aggregated distinct; rows without id
    take no place in it.  The semi join carries no hint: Spark broadcasts the list
    only when its size allows it.
    """
    if n is None:
        return df
    if n < 0:
        raise ValueError("limit must not be negative")
    return df.join(smallest_stores(df, n), "store_id", "left_semi")


def smallest_stores(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` smallest store ids."""
    ids = df.select("store_id").where(F.col("store_id").isNotNull()).distinct()
    return ids.orderBy("store_id").limit(n)


def store_status(
    raw: DataFrame,
    subcategory: str = DEFAULT_SUBCATEGORY,
    scan_type: str = PRODUCT_SCAN_TYPE,
    contract: Contract | None = None,
) -> DataFrame:
    """One row per store: was it processed, or why was it skipped.

    ``contract`` adds ``checks``, the contract's rule counts over the store's
    product rows, taken in the same pass.
    """
    raw = lower_columns(raw)
    is_product = F.coalesce(F.col("scan_type") == scan_type, F.lit(False))
    is_kept = is_product & F.coalesce(F.col("subcategory") == subcategory, F.lit(False))
    counts = [
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(is_product).alias("product_rows"),
        F.count_if(is_kept).alias("subcategory_rows"),
    ]
    if contract is not None:
        counts.append(contract.rule_counts(raw, is_product).alias("checks"))
    status = (
        F.when(F.col("product_rows") == 0, "no_gtin")
        .when(F.col("subcategory_rows") == 0, "no_subcategory")
        .otherwise("processed")
    )
    return raw.groupBy("store_id").agg(*counts).withColumn("status", status)


def total_violations(status: DataFrame) -> DataFrame:
    """Rule counts of all stores together: column, rule, violations."""
    rules = status.select(F.inline("checks"))
    return rules.groupBy("column", "rule").agg(F.sum("violations").alias("violations"))
