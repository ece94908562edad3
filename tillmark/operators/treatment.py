"""Reviewed matches onto the index panel as inspection and issue indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillmark.functions.calendar import to_month
from tillmark.operators.prepare import require_columns


def confirmed_matches(reviewed: DataFrame) -> DataFrame:
    """Rows a reviewer marked as a match."""
    require_columns(reviewed, ["matching"])
    return reviewed.filter(F.col("matching") == 1)


def treatment_months(matched: DataFrame) -> DataFrame:
    """Distinct (store, inspection month, issue month)."""
    return matched.select(
        "store_id",
        to_month(F.col("insp_date")).alias("insp_date"),
        to_month(F.col("issue_date")).alias("issue_date"),
    ).distinct()


# marks one row of every store-month, however many issue months it has
FIRST = "__first"


def assign_treatment(panel: DataFrame, matched: DataFrame, mark_first: bool = False) -> DataFrame:
    """Panel rows with the inspections of their store and month.

    Both indicators sit on the inspection month.  A store-month with several
    issue months appears once per issue month.  The treatment side is reduced
    to distinct months first, so a key holds at most one row per issue month.
    ``mark_first`` adds the column ``FIRST``, which :func:`treated_rows` counts.
    """
    require_columns(panel, ["store_id", "date"])
    months = treatment_months(matched).withColumnRenamed("store_id", "__store")
    if mark_first:
        order = Window.partitionBy("__store", "insp_date").orderBy("issue_date")
        months = months.withColumn(FIRST, F.row_number().over(order) == 1)
    left = panel.withColumn("date", to_month(F.col("date")))
    on = (F.col("store_id") == F.col("__store")) & (F.col("date") == F.col("insp_date"))
    treated = (
        left.join(months, on, "left")
        .drop("__store")
        .withColumn("insp", F.col("insp_date").isNotNull().cast("int"))
        .withColumn("issue", F.col("issue_date").isNotNull().cast("int"))
    )
    return treated.withColumn(FIRST, F.coalesce(FIRST, F.lit(True))) if mark_first else treated


def treated_rows() -> dict[str, Column]:
    """The values of :func:`treatment_counts` as aggregates that a write can take along.

    For rows of :func:`assign_treatment` with ``mark_first`` on a panel that has one row
    per store and month.
    """
    return {
        "rows": F.count(F.lit(1)),
        "store_months": F.count_if(F.col(FIRST)),
        "insp_rows": F.count_if(F.col("insp") == 1),
        "issue_rows": F.count_if(F.col("issue") == 1),
    }


def treatment_counts(treated: DataFrame) -> DataFrame:
    """Rows, inspected rows and issue rows in one aggregation.

    ``store_months`` tells how far several issue months multiplied the panel.
    """
    per_month = treated.groupBy("store_id", "date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("insp").alias("insp"), F.sum("issue").alias("issue")
    )
    return per_month.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("store_months"),
        F.coalesce(F.sum("insp"), F.lit(0)).alias("insp_rows"),
        F.coalesce(F.sum("issue"), F.lit(0)).alias("issue_rows"),
    )
