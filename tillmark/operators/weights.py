"""Revenue totals and the two weight stages, as tables a caller can hold or inspect.

``price_index.geo_index`` does not go through these joins; they exist for users
who keep weights as data (for instance to publish them or to freeze a year).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillmark.functions.numeric import ieee_div, number
from tillmark.operators.joins import null_safe_left_join
from tillmark.operators.prepare import require_columns

REVENUE = "total_revenue_amount"


class RevenueWeights(NamedTuple):
    category: DataFrame
    type: DataFrame
    product: DataFrame


def revenue_total(c: str = REVENUE) -> Column:
    """Sum where a group with no known revenue counts as zero."""
    return F.coalesce(F.sum(number(F.col(c))), F.lit(0.0))


def category_keys(period: str) -> list[str]:
    return ["store_id", "subcategory", period]


def type_keys(period: str) -> list[str]:
    return ["store_id", "subcategory", "product_type", period]


def product_keys(period: str) -> list[str]:
    return ["store_id", "subcategory", "product_type", "gtin", period]


def all_known(names: list[str]) -> Column:
    known = F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull()
    return known


def revenue_weights(df: DataFrame, period: str) -> RevenueWeights:
    """Revenue per category, product type and product in each period.

    The category table leaves out rows with a missing key; the two finer tables
    keep NULL as a group of its own.
    """
    require_columns(df, [*product_keys(period), REVENUE])
    cat, typ, prod = category_keys(period), type_keys(period), product_keys(period)
    return RevenueWeights(
        df.filter(all_known(cat)).groupBy(*cat).agg(revenue_total().alias("category_annual_revenue")),
        df.groupBy(*typ).agg(revenue_total().alias("type_annual_revenue")),
        df.groupBy(*prod).agg(revenue_total().alias("product_annual_revenue")),
    )


def type_weight_table(df: DataFrame, period: str) -> DataFrame:
    """Per store, product type and period: type revenue and its share of the category.

    The fact rows are reduced by map-side aggregation first.  The window then
    runs over the reduced table, where a group is the handful of product types
    one store sells in one period.
    """
    cat = category_keys(period)
    types = df.groupBy(*type_keys(period)).agg(revenue_total().alias("type_annual_revenue"))
    total = F.sum("type_annual_revenue").over(Window.partitionBy(*cat))
    return types.withColumn(
        "stage_2_weight",
        ieee_div(F.col("type_annual_revenue"), F.when(all_known(cat), total)),
    )


def stage_1_weights(weights: RevenueWeights, period: str) -> DataFrame:
    """Product share of its type's revenue."""
    joined = null_safe_left_join(weights.product, weights.type, type_keys(period))
    share = ieee_div(F.col("product_annual_revenue"), F.col("type_annual_revenue"))
    return joined.withColumn("stage_1_weight", share)


def stage_2_weights(weights: RevenueWeights, period: str) -> DataFrame:
    """Type share of the category's revenue."""
    joined = null_safe_left_join(weights.type, weights.category, category_keys(period))
    share = ieee_div(F.col("type_annual_revenue"), F.col("category_annual_revenue"))
    return joined.withColumn("stage_2_weight", share)


def attach_stage_1(rows: DataFrame, stage_1: DataFrame, period: str) -> DataFrame:
    """Stage-1 weight onto store-product-month rows."""
    return null_safe_left_join(rows, stage_1, product_keys(period))


def period_of_month(rows: DataFrame, period: str) -> DataFrame:
    """Distinct (date, period) pairs."""
    return rows.select("date", period).distinct()


def attach_stage_2(type_index: DataFrame, stage_2: DataFrame, period: str) -> DataFrame:
    """Stage-2 weight onto a type index that already carries its period."""
    return null_safe_left_join(type_index, stage_2, type_keys(period))
