"""Two-stage revenue-weighted geometric index of every store and month at once.

    term(product)  = (value / previous month's value) ** (product share of type revenue)
    T(type, month) = product of terms        I(store, month) = product of T ** type share

Plan, and why it holds when one store (or one month of one product) carries a
large part of the rows:

1. rows -> one row per product and month.  Map-side aggregation, so copies of a
   month collapse before they are shuffled.  Skipped when months are unique.
2. one shuffle on (store, product): a window group is at most the months of one
   series.
3. the weights come to where the rows lie.  A weight table that is measured as small
   enough is broadcast to them.  Otherwise the weights meet the revenue of products
   and periods, which is one row for all months of a year and is reduced map-side;
   what they yield per product goes to (store, product) and joins the rows there
   without moving them.  A store with many products is spread over all tasks.
4. two grouped products, both reduced map-side; what is shuffled is at most one
   row per store, type and month from each task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillmark.functions.calendar import month_number
from tillmark.functions.numeric import finite_positive, ieee_div, ieee_pow, number, product_or_null
from tillmark.operators.joins import null_safe_left_join
from tillmark.operators.lags import SERIES, not_ordered, not_unique
from tillmark.operators.prepare import period_column, require_columns, value_column
from tillmark.operators.weights import (
    REVENUE,
    product_keys,
    revenue_total,
    type_keys,
    type_weight_table,
)

# Fixed value: the prefix of the index columns.
DEFAULT_LABEL = "vape"


def index_columns(index_kind: str, label: str = DEFAULT_LABEL) -> tuple[str, str]:
    """Names of the level and the log column."""
    value_column(index_kind)
    level = f"{label}_{index_kind}_index"
    return level, f"l_{level}"


def input_columns(weight_basis: str, index_kind: str, order_col: str | None = None) -> list[str]:
    """The columns of prepared rows that the index reads."""
    names = [*product_keys(period_column(weight_basis)), "date", value_column(index_kind), REVENUE]
    return list(dict.fromkeys(names + ([order_col] if order_col else [])))


def _named() -> Column:
    """Does the row belong to a series?"""
    return F.col("store_id").isNotNull() & F.col("gtin").isNotNull()


MONTH_ENDS = ("opening", "closing", "opens_at", "closes_at")


def _single_months(df: DataFrame, value_col: str, groups: list[str]) -> DataFrame:
    """Rows that each are a product's only one of the month."""
    revenue = F.coalesce(number(F.col(REVENUE)), F.lit(0.0)).alias("revenue")
    return df.select(*groups, revenue, *[number(F.col(value_col)).alias(c) for c in MONTH_ENDS])


def _unnamed_months(df: DataFrame, groups: list[str]) -> DataFrame:
    """Months of rows without store or product: revenue, and no values to compare."""
    months = df.groupBy(*groups).agg(revenue_total().alias("revenue"))
    return months.withColumns({c: F.lit(None).cast("double") for c in MONTH_ENDS})


def _product_months(
    df: DataFrame, value_col: str, period: str, order_col: str | None, unique_months: bool
) -> DataFrame:
    """One row per store, product, type and month with its revenue and end values.

    ``opens_at`` and ``closes_at`` place the row among those of its month.  With
    a plain ``order_col`` all buffers are fixed-width, so the aggregation hashes;
    two rows of one product-month with the same order fail the query.
    """
    value = number(F.col(value_col))
    groups = [*product_keys(period), "date"]
    if unique_months:
        # rows without store or product have no lag, may repeat, and are one row a month
        known = _single_months(df.where(_named()), value_col, groups)
        return known.unionByName(_unnamed_months(df.where(~_named()), groups))
    if order_col is None:
        # rows of a month in order of value, unknown values first
        first = F.when(F.count_if(value.isNull()) == 0, F.min(value))
        ends = [first, F.max(value), first, F.max(value)]
    else:
        at = F.col(order_col)
        lines = df.groupBy(*groups, order_col).agg(
            revenue_total().alias(REVENUE), F.first(value).alias(value_col), F.count(F.lit(1)).alias("__rows")
        )
        once = F.when(F.col("__rows") > 1, not_ordered()).otherwise(F.col(value_col))
        df = lines.withColumn(value_col, once)
        ends = [F.min_by(value, at), F.max_by(value, at), F.min(at), F.max(at)]
    return df.groupBy(*groups).agg(
        revenue_total().alias("revenue"), *[e.alias(n) for e, n in zip(ends, MONTH_ENDS)]
    )


def _ratios(months: DataFrame, period: str, unique_months: bool) -> DataFrame:
    """Month-on-month ratio and product revenue, in one (store, product) shuffle."""
    months = months.withColumn("month_no", month_number(F.col("date")))
    series = Window.partitionBy(*SERIES)
    named = _named()
    if unique_months:
        in_order = series.orderBy("month_no")
        before = F.lag("month_no").over(in_order)
        previous = F.when(named & (before == F.col("month_no")), not_unique()).when(
            before == F.col("month_no") - 1, F.lag("closing").over(in_order)
        )
    else:
        # a product sold under two types has two rows in a month: only the
        # month's first row has a lag, taken from the previous month's last row
        in_order = series.orderBy("month_no", "opens_at", "subcategory", "product_type")
        before = F.lag("month_no").over(in_order)
        opens = before.isNull() | (before < F.col("month_no"))
        last_month = series.orderBy("month_no").rangeBetween(-1, -1)
        last_row = F.max(F.struct("closes_at", "closing")).over(last_month)
        previous = F.when(opens, last_row["closing"])
    return months.select(
        *product_keys(period),
        "date",
        F.try_divide(F.col("opening"), F.when(named, previous)).alias("ratio"),
        F.sum("revenue").over(Window.partitionBy(*product_keys(period))).alias("product_revenue"),
    )


def broadcastable(df: DataFrame) -> bool:
    """Is it a stored table, whose size is measured, and small enough for Spark to broadcast?"""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    plan = df._jdf.queryExecution().optimizedPlan()
    return plan.children().isEmpty() and int(str(plan.stats().sizeInBytes())) <= limit


def _series_shares(df: DataFrame, weights: DataFrame, period: str) -> DataFrame:
    """Per store and product a short list ``held``: share and stage-2 weight of each type and period.

    A product's revenue is one row for all months of a period and is reduced map-side.
    """
    products = df.where(_named()).groupBy(*product_keys(period)).agg(
        revenue_total().alias("product_revenue")
    )
    share = ieee_div(F.col("product_revenue"), F.col("type_annual_revenue")).alias("share")
    entry = F.struct("subcategory", "product_type", period, share, "stage_2_weight")
    joined = null_safe_left_join(products, weights, type_keys(period))
    return joined.groupBy(*SERIES).agg(F.collect_list(entry).alias("held"))


def _weighted_in_place(
    df: DataFrame,
    weights: DataFrame,
    value_col: str,
    period: str,
    order_col: str | None,
    unique_months: bool,
) -> DataFrame:
    """Ratios with ``share`` and ``stage_2_weight``, the rows of a series shuffled once.

    A series picks its weights from its own list.  Rows without store or product
    belong to no series; they are combined and join by type.
    """
    groups = [*product_keys(period), "date"]
    rows = df.where(_named())
    if unique_months:
        months = _single_months(rows, value_col, groups)
    else:
        months = _product_months(rows, value_col, period, order_col, False)
    picked = ["subcategory", "product_type", period]

    def fits(entry: Column) -> Column:
        return reduce(lambda a, b: a & b, [entry[c].eqNullSafe(F.col(c)) for c in picked])

    held = _ratios(months, period, unique_months).drop("product_revenue").join(
        _series_shares(df, weights, period), SERIES, "left"
    )
    columns = [*groups, "ratio", "share", "stage_2_weight"]
    found = held.withColumn("__entry", F.get(F.filter("held", fits), F.lit(0)))
    in_place = found.withColumns({c: F.col(f"__entry.{c}") for c in columns[-2:]}).select(*columns)

    other = _unnamed_months(df.where(~_named()), groups)
    revenue = F.sum("revenue").over(Window.partitionBy(*product_keys(period)))
    other = null_safe_left_join(other.withColumn("product_revenue", revenue), weights, type_keys(period))
    share = ieee_div(F.col("product_revenue"), F.col("type_annual_revenue"))
    other = other.withColumns({"ratio": F.lit(None).cast("double"), "share": share})
    return in_place.unionByName(other.select(*columns))


def type_index(
    df: DataFrame,
    weight_basis: str = "fiscal",
    index_kind: str = "price",
    order_col: str | None = None,
    unique_months: bool = False,
    type_weights: DataFrame | None = None,
) -> DataFrame:
    """Stage 1: index and stage-2 weight per store, subcategory, type and month.

    ``type_weights`` takes the result of ``type_weight_table`` for the same rows
    and period.  Given as a stored table, its size is known, and a small one is
    broadcast.  In every other case the weights go to the rows' place, so that rows
    are shuffled once at any size.
    """
    period, value_col = period_column(weight_basis), value_column(index_kind)
    extra = [] if order_col is None else [order_col]
    require_columns(df, [*product_keys(period), "date", value_col, REVENUE, *extra])

    if type_weights is not None and broadcastable(type_weights):
        months = _product_months(df, value_col, period, order_col, unique_months)
        joined = null_safe_left_join(
            _ratios(months, period, unique_months), type_weights, type_keys(period)
        )
        share = ieee_div(F.col("product_revenue"), F.col("type_annual_revenue"))
        weighted = joined.withColumn("share", share)
    else:
        weights = type_weight_table(df, period) if type_weights is None else type_weights
        weighted = _weighted_in_place(df, weights, value_col, period, order_col, unique_months)
    return (
        weighted.withColumn("term", finite_positive(ieee_pow(F.col("ratio"), F.col("share"))))
        # the period is a function of the month, so it is not a grouping key
        .groupBy("store_id", "subcategory", "product_type", "date")
        .agg(
            finite_positive(product_or_null(F.col("term"))).alias("type_index"),
            F.max("stage_2_weight").alias("stage_2_weight"),
        )
    )


def store_index(types: DataFrame, index_kind: str = "price", label: str = DEFAULT_LABEL) -> DataFrame:
    """Stage 2: weighted product of the type indexes of each store and month."""
    level, log = index_columns(index_kind, label)
    weighted = ieee_pow(F.col("type_index"), F.col("stage_2_weight"))
    return (
        types.dropna(subset=["store_id", "subcategory", "date"])
        .groupBy("store_id", "subcategory", "date")
        .agg(finite_positive(product_or_null(weighted)).alias(level))
        .select("store_id", "date", level, F.ln(level).alias(log))
    )


def geo_index(
    df: DataFrame,
    weight_basis: str = "fiscal",
    index_kind: str = "price",
    label: str = DEFAULT_LABEL,
    order_col: str | None = None,
    unique_months: bool = False,
    type_weights: DataFrame | None = None,
) -> DataFrame:
    """Store-month index and its log from prepared rows of one subcategory.

    ``weight_basis`` picks fiscal- or calendar-year revenue shares,
    ``index_kind`` the unit value (``price``) or the quantity (``qty``).
    ``order_col`` orders rows that share store, product and month.
    ``unique_months=True`` states that there are none, which saves a shuffle; the
    query fails if there are.  ``type_weights`` is described at :func:`type_index`.
    """
    types = type_index(df, weight_basis, index_kind, order_col, unique_months, type_weights)
    return store_index(types, index_kind, label)
