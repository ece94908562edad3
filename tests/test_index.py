"""Golden values, edge rules and a random comparison with the brute-force formula."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tests import bruteforce
from tillmark.functions.calendar import FiscalCalendar, month_number
from tillmark.operators import lags, prepare, price_index, weights
from tillmark.operators.contracts import STORE_CONTRACT, index_contract

PREPARED = (
    "store_id string, gtin string, subcategory string, product_type string, calendar_year int,"
    " calendar_month int, date date, fiscal_year int, unit_value_q double, quantity int,"
    " total_revenue_amount int, scan_type string"
)


def prepared(spark, rows):
    """rows: (gtin, type, year, month, price, quantity, revenue)."""
    full = []
    for gtin, kind, year, month, price, quantity, revenue in rows:
        date = dt.date(year, month, 1)
        fiscal = year + (month >= 7)
        full.append(
            ("1", gtin, "Vaping Products", kind, year, month, date, fiscal, price, quantity,
             revenue, "GTIN")
        )
    return spark.createDataFrame(full, PREPARED)


def series(df, kind="price", log=False):
    column = price_index.index_columns(kind)[1 if log else 0]
    return [r[column] for r in df.orderBy("date").collect()]


def approx(values):
    return [v if v is None else pytest.approx(v, rel=1e-7) for v in values]


@pytest.fixture(params=[True, False], ids=["unique", "combine"])
def unique(request):
    return request.param


# --- golden tables ---------------------------------------------------------


def tiny_raw(spark):
    """Raw rows of one product over one spring, upper-case names."""
    from tillmark.sources.readers import store_schema

    schema = store_schema(upper=True)
    fixed = dict(
        STORE_ID=77, CALENDAR_YEAR=2023, GTIN="00981", TRANSACTION_COUNT=4,
        TRANSACTION_COUNT_WITH_DISCOUNT=0, QUANTITY_WITH_DISCOUNT=0.0, SCAN_TYPE="GTIN",
        SUBCATEGORY="Vaping Products", PRODUCT_TYPE="Pods",
    )
    rows = []
    for month, price, quantity in ((3, 4.0, 8.0), (4, 5.0, 20.0), (5, 4.0, 15.0)):
        row = fixed | dict(
            CALENDAR_MONTH=month, UNIT_VALUE_Q=price, QUANTITY=quantity, Q_PLUS_QWD=quantity,
            TOTAL_REVENUE_AMOUNT=price * quantity,
        )
        rows.append(tuple(row.get(n) for n in schema.names))
    return spark.createDataFrame(rows, schema)


def test_tiny_store_end_to_end(spark, unique):
    raw = tiny_raw(spark)
    rows = prepare.prepare_store(raw)
    assert {"date", "fiscal_year"} <= set(rows.columns)
    assert [r.fiscal_year for r in rows.collect()] == [2023] * 3
    kept = prepare.filter_subcategory(STORE_CONTRACT.enforce(rows))
    price = index_contract("price").enforce(price_index.geo_index(kept, unique_months=unique))
    assert series(price) == approx([None, 1.25, 0.8])
    assert series(price, log=True) == approx([None, math.log(1.25), -math.log(1.25)])
    qty = price_index.geo_index(kept, index_kind="qty", unique_months=unique)
    assert series(index_contract("qty").enforce(qty), "qty") == approx([None, 2.5, 0.75])


def test_gap_month_has_no_index(spark, unique):
    df = prepared(spark, [
        ("g", "Bulk", 2024, 5, 4.0, 1, 7), ("g", "Bulk", 2024, 6, 5.0, 1, 7),
        ("g", "Bulk", 2024, 9, 8.0, 1, 7), ("g", "Bulk", 2024, 10, 6.0, 1, 7),
    ])
    assert series(price_index.geo_index(df, unique_months=unique)) == approx([None, 1.25, None, 0.75])


def test_price_and_quantity_differ(spark, unique):
    steps = [(2, 8.0, 10), (3, 10.0, 5), (4, 5.0, 20), (5, 6.0, 16)]
    df = prepared(spark, [("g", "Bulk", 2024, m, p, q, 1) for m, p, q in steps])
    price = price_index.geo_index(df, "calendar", "price", unique_months=unique)
    qty = price_index.geo_index(df, "calendar", "qty", unique_months=unique)
    assert series(price) == approx([None, 1.25, 0.5, 1.2])
    assert series(qty, "qty") == approx([None, 0.5, 4.0, 0.8])


def test_fiscal_and_calendar_differ_under_a_mix_shift(spark, unique):
    # X doubles each month, Y stands still: the index is 2 to the power of X's share
    rows = []
    for k, (y, m) in enumerate([(2023, 11), (2023, 12), (2024, 1), (2024, 2)]):
        sold = (300, 100) if y == 2023 else (100, 300)
        rows += [("X", "Bulk", y, m, 2.0**k, 1, sold[0]), ("Y", "Bulk", y, m, 3.0, 1, sold[1])]
    df = prepared(spark, rows)
    fiscal = series(price_index.geo_index(df, "fiscal", unique_months=unique))
    calendar = series(price_index.geo_index(df, "calendar", unique_months=unique))
    assert fiscal == approx([None] + [2**0.5] * 3)
    assert calendar == approx([None, 2**0.75, 2**0.25, 2**0.25])


# --- edge rules ------------------------------------------------------------


def type_levels(df, **options):
    types = price_index.type_index(df, "calendar", **options)
    return {(r.product_type, r.date.month): r.type_index for r in types.collect()}


def test_zero_revenue_product_without_lag_counts_as_one(spark, unique):
    df = prepared(spark, [
        ("A", "Pods", 2023, 1, 10.0, 1, 0), ("B", "Pods", 2023, 2, 10.0, 1, 50),
    ])
    assert type_levels(df, unique_months=unique) == {("Pods", 1): 1.0, ("Pods", 2): None}


@pytest.mark.parametrize(("before", "now"), [(0.0, 5.0), (5.0, 0.0), (-5.0, 5.0), (5.0, None)])
def test_unusable_ratio_is_missing(spark, unique, before, now):
    df = prepared(spark, [
        ("A", "Pods", 2023, 1, before, 1, 30), ("A", "Pods", 2023, 2, now, 1, 30),
        ("B", "Pods", 2023, 1, 2.0, 1, 20), ("B", "Pods", 2023, 2, 2.0, 1, 20),
    ])
    assert type_levels(df, unique_months=unique)["Pods", 2] == 1.0  # only B's unchanged price
    only_a = df.filter("gtin = 'A' or date < '2023-02-01'")
    assert type_levels(only_a, unique_months=unique)["Pods", 2] is None


def test_type_revenue_of_zero_keeps_unchanged_prices(spark, unique):
    df = prepared(spark, [
        ("A", "Pods", 2023, 1, 5.0, 1, 40), ("A", "Pods", 2023, 2, 5.0, 1, -40),
        ("B", "Pods", 2023, 1, 5.0, 1, 40), ("B", "Pods", 2023, 2, 6.0, 1, -40),
        ("C", "Bulk", 2023, 1, 5.0, 1, 30), ("C", "Bulk", 2023, 2, 6.0, 1, -40),
        ("D", "Bulk", 2023, 1, 5.0, 1, 10), ("D", "Bulk", 2023, 2, 5.0, 1, 0),
    ])
    levels = type_levels(df, unique_months=unique)
    assert levels["Pods", 2] == 1.0  # A: 1 ** nan, B: 1.2 ** nan missing
    assert levels["Bulk", 2] == 1.0  # D: 1 ** inf, C: 1.2 ** -inf is not positive


def test_missing_type_is_a_type_of_its_own(spark, unique):
    df = prepared(spark, [
        ("A", None, 2023, 1, 10.0, 1, 60), ("A", None, 2023, 2, 20.0, 1, 60),
        ("B", "Pods", 2023, 1, 10.0, 1, 40), ("B", "Pods", 2023, 2, 10.0, 1, 40),
    ])
    assert type_levels(df, unique_months=unique)[None, 2] == pytest.approx(2.0)
    index = price_index.geo_index(df, "calendar", unique_months=unique)
    assert series(index) == approx([None, 2.0**0.6])


def test_months_outside_the_fiscal_window(spark, unique):
    df = prepared(spark, [
        ("A", "Pods", 2019, 1, 5.0, 1, 10), ("A", "Pods", 2019, 2, 5.0, 1, 10),
        ("A", "Pods", 2019, 3, 6.0, 1, 10),
    ]).withColumn("fiscal_year", FiscalCalendar().fiscal_year(F.col("date")))
    assert series(price_index.geo_index(df, unique_months=unique)) == [None, 1.0, None]


def test_duplicate_month_uses_first_and_last_row(spark):
    df = prepared(spark, [
        ("A", "Pods", 2023, 1, 10.0, 1, 10), ("A", "Pods", 2023, 2, 12.0, 2, 10),
        ("A", "Pods", 2023, 2, 30.0, 3, 10), ("A", "Pods", 2023, 3, 60.0, 4, 10),
    ])
    index = price_index.geo_index(df, "calendar", order_col="quantity")
    assert series(index) == approx([None, 1.2, 2.0])
    out = lags.value_lags(df, "unit_value_q", order_col="quantity").orderBy("quantity").collect()
    assert [(r.month_diff, r.lag_value) for r in out] == [(None, None), (1, 10.0), (0, None), (1, 30.0)]


def test_identical_copies_take_the_lag_once(spark):
    df = prepared(spark, [("A", "Pods", 2023, 1, 10.0, 1, 10)] + 5 * [("A", "Pods", 2023, 2, 12.0, 1, 10)])
    out = lags.value_lags(df, "unit_value_q").filter("month(date) = 2").collect()
    assert sorted((r.month_diff, r.lag_value) for r in out if r.lag_value) == [(1, 10.0)]
    assert sum(r.month_diff == 0 and r.lag_value is None for r in out) == 4
    assert series(price_index.geo_index(df, "calendar")) == approx([None, 1.2])


def test_a_repeated_order_fails(spark):
    df = prepared(spark, [("A", "Pods", 2023, 1, 10.0, 1, 10), ("A", "Pods", 2023, 1, 12.0, 1, 10)])
    with pytest.raises(Exception, match="order_col repeats"):
        lags.value_lags(df, "unit_value_q", order_col="quantity").collect()
    with pytest.raises(Exception, match="order_col repeats"):
        price_index.geo_index(df, "calendar", order_col="quantity").collect()


def test_a_million_copies_are_written_by_several_tasks(spark):
    one = prepared(spark, [("A", "Pods", 2023, 1, 10.0, 1, 10)]).withColumn("k", F.lit(1))
    two = prepared(spark, [("A", "Pods", 2023, 2, 12.0, 1, 10)]).withColumn("k", F.lit(1))
    copies = spark.range(0, 1_000_000, 1, 8).select(F.lit(1).alias("k")).join(F.broadcast(two), "k")
    out = lags.value_lags(one.unionByName(copies).drop("k"), "unit_value_q")
    tasks = out.withColumn("task", F.spark_partition_id()).groupBy("task").agg(
        F.count(F.lit(1)).alias("n"), F.count("lag_value").alias("lags")
    ).collect()
    assert sum(r.n for r in tasks) == 1_000_001 and sum(r.lags for r in tasks) == 1
    assert sum(r.n > 50_000 for r in tasks) > 1


def test_rows_without_product_meet_no_window(spark):
    rows = [(None, "Pods", 2023, 1, 1.0, 1, 10)] * 3 + [("A", "Pods", 2023, m, 2.0**m, 1, 10) for m in (1, 2)]
    df = prepared(spark, rows)
    for unique in (True, False):
        out = lags.value_lags(df, "unit_value_q", unique_months=unique)
        got = out.where("gtin is null").select("month_diff", "lag_value").collect()
        assert [tuple(r) for r in got] == [(None, None)] * 3
        branches = out._jdf.queryExecution().optimizedPlan().children()
        named, unnamed = branches.head().toString(), branches.last().toString()
        assert "Window" in named and "isnotnull(gtin" in named and "Window" not in unnamed
        index = price_index.geo_index(df, "calendar", unique_months=unique)
        assert series(index) == approx([None, 2.0 ** (20 / 50)])


def test_a_wrong_claim_of_unique_months_fails(spark):
    df = prepared(spark, [("A", "Pods", 2023, 1, 1.0, 1, 1), ("A", "Bulk", 2023, 1, 1.0, 1, 1)])
    with pytest.raises(Exception, match="two rows in one month"):
        price_index.geo_index(df, "calendar", unique_months=True).collect()
    with pytest.raises(Exception, match="two rows in one month"):
        lags.value_lags(df, "unit_value_q", unique_months=True).collect()


def test_product_that_changes_type_keeps_its_lag(spark, unique):
    df = prepared(spark, [
        ("A", "Pods", 2023, 1, 10.0, 1, 10), ("A", "Bulk", 2023, 2, 15.0, 1, 10),
    ])
    assert type_levels(df, unique_months=unique)["Bulk", 2] == pytest.approx(1.5)


def test_lag_crosses_the_year_boundary_with_the_new_weight(spark, unique):
    df = prepared(spark, [
        ("A", "Pods", 2023, 6, 10.0, 1, 90), ("B", "Pods", 2023, 6, 10.0, 1, 10),
        ("A", "Pods", 2023, 7, 20.0, 1, 25), ("B", "Pods", 2023, 7, 10.0, 1, 75),
    ])
    assert series(price_index.geo_index(df, unique_months=unique)) == approx([None, 2.0**0.25])


def test_nan_is_missing_and_unknown_revenue_is_zero(spark, unique):
    df = prepared(spark, [
        ("A", "Pods", 2023, 1, 10.0, 1, 10), ("A", "Pods", 2023, 2, 20.0, 1, 10),
        ("B", "Pods", 2023, 1, 10.0, 1, None), ("B", "Pods", 2023, 2, 30.0, 1, None),
        ("A", "Pods", 2023, 3, float("nan"), 1, 10),
    ])
    df = df.withColumn("total_revenue_amount", F.coalesce(F.col("total_revenue_amount").cast("double"), F.lit(float("nan"))))
    # B has weight 0: its term is 1 in every month, with or without a lag
    assert series(price_index.geo_index(df, "calendar", unique_months=unique)) == approx([1.0, 2.0, None])


def test_unknown_product_code_has_no_lag(spark):
    df = prepared(spark, [(None, "Pods", 2023, 1, 1.0, 1, 10), (None, "Pods", 2023, 2, 2.0, 1, 10)])
    for flag in (True, False):
        assert {r.lag_value for r in lags.value_lags(df, "unit_value_q", unique_months=flag).collect()} == {None}
        assert series(price_index.geo_index(df, "calendar", unique_months=flag)) == [None, None]


def test_bad_options_fail_early(spark):
    df = prepared(spark, [("A", "Pods", 2023, 1, 1.0, 1, 1)])
    with pytest.raises(ValueError):
        price_index.geo_index(df, weight_basis="lunar")
    with pytest.raises(ValueError):
        price_index.geo_index(df, index_kind="volume")
    with pytest.raises(KeyError):
        lags.value_lags(df, "no_such_column")


def test_fiscal_year_parameters(spark):
    dates = [(dt.date(2021, 12, 1),), (dt.date(2022, 6, 1),), (dt.date(2022, 7, 1),), (dt.date(2025, 7, 1),)]
    df = spark.createDataFrame(dates, "date date")
    default = df.select(FiscalCalendar().fiscal_year(F.col("date")).alias("y")).collect()
    assert [r.y for r in default] == [None, 2022, 2023, None]
    months = FiscalCalendar().months()
    assert list(months) == [2022, 2023, 2024, 2025] and len(months[2022]) == 6
    assert months[2023][0] == "2022-07" and months[2025][-1] == "2025-06"
    january = FiscalCalendar(1, dt.date(2021, 1, 1), dt.date(2025, 12, 1))
    assert [r[0] for r in df.select(january.fiscal_year(F.col("date"))).collect()] == [2021, 2022, 2022, 2025]
    with pytest.raises(ValueError):
        FiscalCalendar(13)


# --- random tables against the brute-force formula -------------------------


def random_rows(seed, duplicates):
    rng = random.Random(seed)
    rows = []
    for store in range(5):
        for item in range(8):
            kinds = rng.sample([None, "Pods", "Bulk", "Disposable"], 2)
            for month in range(2021 * 12 + 7, 2023 * 12 + 9):
                if rng.random() < 0.25:
                    continue
                for _ in range(rng.choice([1, 1, 3]) if duplicates else 1):
                    year, m = divmod(month - 1, 12)
                    inside = dt.date(2022, 1, 1) <= dt.date(year, m + 1, 1) <= dt.date(2025, 6, 1)
                    rows.append(
                        dict(
                            seq=len(rows), store_id=store, gtin=f"g{item}", month=month,
                            subcategory="S", product_type=kinds[rng.random() < 0.1],
                            date=dt.date(year, m + 1, 1), calendar_year=year,
                            fiscal_year=year + (m >= 6) if inside else None,
                            unit_value_q=rng.choice([None, 0.0, 2.0, -1.0] + [round(rng.uniform(1, 9), 2)] * 12),
                            quantity=float(rng.randrange(1, 5)),
                            total_revenue_amount=float(rng.choice([0, -20] + [rng.randrange(1, 99)] * 8)),
                        )
                    )
    return rows


@pytest.mark.parametrize("kind", ["price", "qty"])
@pytest.mark.parametrize("basis", ["fiscal", "calendar"])
@pytest.mark.parametrize("duplicates", [False, True])
def test_random_table_matches_the_formula(spark, kind, basis, duplicates):
    rows = random_rows(7, duplicates)
    schema = StructType.fromDDL(
        "seq int, store_id int, gtin string, subcategory string, product_type string, date date,"
        " calendar_year int, fiscal_year int, unit_value_q double, quantity double,"
        " total_revenue_amount double"
    )
    df = spark.createDataFrame([tuple(r[n] for n in schema.names) for r in rows], schema)
    wanted = bruteforce.index(rows, prepare.value_column(kind), prepare.period_column(basis))
    level = price_index.index_columns(kind)[0]
    runs = [dict(order_col="seq")]
    if not duplicates:
        runs.append(dict(unique_months=True))
        stored = weights.type_weight_table(df, prepare.period_column(basis))
        runs.append(dict(unique_months=True, type_weights=stored))
    for options in runs:
        out = price_index.geo_index(df, basis, kind, **options)
        got = {
            (r.store_id, r.m): r[level]
            for r in out.withColumn("m", month_number(F.col("date"))).collect()
        }
        assert got.keys() == wanted.keys()
        assert sum(v is not None for v in wanted.values()) > 20
        for key, value in wanted.items():
            if value is None:
                assert got[key] is None, key
            else:
                assert math.isclose(got[key], value, rel_tol=1e-9), key


@pytest.mark.parametrize("duplicates", [False, True])
def test_random_lags(spark, duplicates):
    rows = random_rows(3, duplicates)
    df = spark.createDataFrame(
        [(r["seq"], r["store_id"], r["gtin"], r["date"], r["unit_value_q"]) for r in rows],
        "seq int, store_id int, gtin string, date date, unit_value_q double",
    )
    wanted, last = {}, {}
    for r in sorted(rows, key=lambda r: (r["store_id"], r["gtin"], r["month"], r["seq"])):
        key = r["store_id"], r["gtin"]
        gap = r["month"] - last[key]["month"] if key in last else None
        wanted[r["seq"]] = gap, last[key]["unit_value_q"] if gap == 1 else None
        last[key] = r
    for flag in {False, not duplicates}:
        out = lags.value_lags(df, "unit_value_q", order_col="seq", unique_months=flag)
        assert {r.seq: (r.month_diff, r.lag_value) for r in out.collect()} == wanted
