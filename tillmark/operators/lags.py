"""Previous-month value of every store-product series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillmark.functions.calendar import month_number
from tillmark.functions.numeric import number
from tillmark.operators.prepare import require_columns

SERIES = ["store_id", "gtin"]


def not_unique() -> Column:
    """Fails the query when a series that was said to have unique months has not."""
    return F.raise_error("a store-product series has two rows in one month").cast("double")


def not_ordered() -> Column:
    """Fails the query when two rows of a month have the same place in its order."""
    return F.raise_error("order_col repeats within a month").cast("double")


# copies of a row that one task writes out again at a time
COPIES = 1 << 12


def value_lags(
    df: DataFrame,
    value_col: str,
    out_value_col: str = "value",
    out_lag_value_col: str = "lag_value",
    order_col: str | None = None,
    unique_months: bool = False,
) -> DataFrame:
    """Add ``month_diff``, the value and its lag (only across consecutive months).

    Rows of one store-product series are ordered by month.  When a month has
    several rows, the first takes the lag of the previous month's last row and
    the others follow it at distance 0.  ``order_col`` is the row order inside a
    month; the query fails if two rows of a month share it.  Without it rows are
    ordered by value and then by their remaining columns.

    Rows without store or product have no lag and no distance; they go around the
    windows and shuffles.

    ``unique_months=True`` states that a series has one row per month; the query
    fails if it has more.  The lag is then one window with one shuffle, over
    groups no larger than the number of months.  Otherwise months are reduced by
    map-side aggregation before the window, and the rows pick the result up in an
    equi-join, which AQE splits where a month is hot.  No row is a key of an
    aggregation, whatever its width, unless it ties with others for the first place
    of its month (without ``order_col``).  Identical ones of these are counted, and
    one of them may open its month; the others are dealt out in lots of ``COPIES``.
    """
    require_columns(df, [*SERIES, "date", value_col])
    rows = df.withColumn(out_value_col, number(F.col(value_col)))
    named = F.col("store_id").isNotNull() & F.col("gtin").isNotNull()
    unnamed = rows.where(~named).withColumns(
        {"month_diff": F.lit(None).cast("int"), out_lag_value_col: F.lit(None).cast("double")}
    )
    rows = rows.where(named)
    columns = [*df.columns, "month_diff", out_value_col, out_lag_value_col]
    columns = list(dict.fromkeys(columns))
    series = Window.partitionBy(*SERIES).orderBy("date")
    month = [*SERIES, "date"]
    number_of_month = month_number(F.col("date"))

    if unique_months:
        gap = number_of_month - F.lag(number_of_month).over(series)
        previous = F.lag(out_value_col).over(series)
        distance = F.when(gap == 0, not_unique().cast("int")).otherwise(gap)
        lagged = rows.withColumn("month_diff", distance).withColumn(
            out_lag_value_col, F.when(F.col("month_diff") == 1, previous)
        )
        return lagged.select(*columns).unionByName(unnamed.select(*columns))

    value = F.col(out_value_col)
    if order_col is None:
        # fixed-width buffers only; unknown values come first
        ends = rows.groupBy(*month).agg(
            F.when(F.count_if(value.isNull()) == 0, F.min(value)).alias("__open"),
            F.max(value).alias("__close"),
            F.count(F.lit(1)).alias("__rows"),
        )
        place = value
    else:
        place = F.col(order_col)
        placed = rows.groupBy(*month, order_col).agg(
            F.first(value).alias("__value"), F.count(F.lit(1)).alias("__rows")
        )
        checked = F.when(F.col("__rows") > 1, not_ordered()).otherwise(F.col("__value"))
        ends = placed.groupBy(*month).agg(
            F.min(place).alias("__open"), F.max_by(checked, place).alias("__close"), F.lit(1).alias("__rows")
        )

    months = ends.select(
        *month,
        "__open",
        "__rows",
        (number_of_month - F.lag(number_of_month).over(series)).alias("__gap"),
        F.lag("__close").over(series).alias("__previous"),
    )
    joined = rows.join(months, month, "left")
    first = F.coalesce("__rows", F.lit(0)).cast("boolean") & place.eqNullSafe(F.col("__open"))
    if order_col is None:
        tied = first & (F.col("__rows") > 1)
        lagged = _lagged(joined.where(~tied), first, out_lag_value_col).select(*columns)
        lagged = lagged.unionByName(_tied_rows(joined.where(tied), rows.columns, out_lag_value_col).select(*columns))
    else:
        lagged = _lagged(joined, first, out_lag_value_col).select(*columns)
    return lagged.unionByName(unnamed.select(*columns))


def _lagged(rows: DataFrame, opens: Column, out_lag_value_col: str) -> DataFrame:
    """Distance and lag go to the row that opens its month; the others follow at distance 0."""
    distance = F.when(opens, F.col("__gap")).otherwise(F.lit(0))
    return rows.withColumn("month_diff", distance).withColumn(
        out_lag_value_col, F.when(F.col("month_diff") == 1, F.col("__previous"))
    )


def _tied_rows(tied: DataFrame, names: list[str], out_lag_value_col: str) -> DataFrame:
    """Rows that share their month's first value: one of the smallest by all columns opens it.

    Identical rows are dealt out evenly and counted.  One of them may open the month;
    the others are dealt out in lots before they are written out again.
    """
    month = [*SERIES, "date"]
    # a fixed number of tasks: what one task counts or writes does not hang on the key
    tasks = int(tied.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = ["__gap", "__previous"]
    copies = tied.select(*names, *known).repartition(tasks).groupBy(*names, *known).agg(
        F.count(F.lit(1)).alias("__copies")
    )
    key = F.struct(*[c for c in names if c not in month])
    openers = copies.groupBy(*month).agg(F.min(key).alias("__opener"))
    once = _lagged(copies.join(openers, month), key.eqNullSafe(F.col("__opener")), out_lag_value_col)

    one = F.lit(1).cast("long")
    several = copies.where("__copies > 1").withColumn("__copies", F.col("__copies") - 1)
    lots = F.ceil(F.col("__copies") / COPIES).cast("long")
    lot = several.withColumn("__lot", F.explode(F.sequence(one, lots))).withColumn(
        "__size", F.least(F.lit(COPIES), F.col("__copies") - (F.col("__lot") - 1) * COPIES)
    )
    dealt = lot.repartition(tasks, *month, "__lot")
    follow = _lagged(dealt.withColumn("__copy", F.explode(F.sequence(one, F.col("__size")))), F.lit(False), out_lag_value_col)
    columns = [*names, "month_diff", out_lag_value_col]
    columns = list(dict.fromkeys(columns))
    return once.select(*columns).unionByName(follow.select(*columns))
