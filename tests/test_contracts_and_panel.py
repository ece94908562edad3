from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_index import tiny_raw
from tillmark.operators import panel, prepare
from tillmark.operators.contracts import STORE_CONTRACT, ContractError, index_contract
from tillmark.operators.price_index import index_columns

LEVEL, LOG = index_columns("price")
DAY = dt.date(2023, 1, 1)


def broken(df, contract):
    return {(r["column"], r["rule"]): r["violations"] for r in contract.violations(df).collect() if r["violations"]}


def index(spark, rows):
    return spark.createDataFrame(rows, f"store_id long, date date, {LEVEL} double, {LOG} double")


def test_input_contract(spark):
    df = prepare.lower_columns(tiny_raw(spark))
    assert broken(df, STORE_CONTRACT) == {}
    assert "extra" in STORE_CONTRACT.enforce(df.withColumn("extra", F.lit(1))).columns
    bad = (
        df.drop("brand")
        .withColumn("gtin", F.lit(None).cast("string"))
        .withColumn("quantity", F.lit("12x"))
        .withColumn("transaction_count", F.lit(float("nan")))
        .withColumn("calendar_year", F.lit("2022"))
        .withColumn("unit_value_q", F.lit(float("nan")))
    )
    assert broken(bad, STORE_CONTRACT) == {
        ("brand", "missing_column"): 1, ("gtin", "not_null"): 3, ("quantity", "coercion"): 3,
        ("transaction_count", "not_null"): 3,
    }
    with pytest.raises(ContractError, match="gtin: not_null x3"):
        STORE_CONTRACT.enforce(bad)
    fixed = STORE_CONTRACT.coerce(df.withColumn("gtin", F.lit(77)).withColumn("unit_value_q", F.lit(float("nan"))))
    row = fixed.first()
    assert row.gtin == "77" and row.unit_value_q is None and dict(fixed.dtypes)["store_id"] == "bigint"


def test_index_contract(spark):
    good = index(spark, [(1, DAY, 1.0, 0.0), (2, DAY, None, None), (3, DAY, 0.0, None)])
    assert index_contract("price").enforce(good).count() == 3
    inf = float("inf")
    bad = index(spark, [(1, DAY, -1.0, 0.0), (1, DAY, inf, -inf), (1, DAY, None, None)])
    assert broken(bad.withColumn("note", F.lit(1)), index_contract("price")) == {
        (LEVEL, "at_least_0"): 1, (LEVEL, "finite"): 1, (LOG, "finite"): 1,
        ("note", "extra_column"): 1, ("store_id,date", "unique"): 2,
    }
    with pytest.raises(ContractError):
        index_contract("qty").enforce(good)


def test_keep_first_and_duplicates(spark):
    df = spark.createDataFrame([(1, DAY, 3, "c"), (1, DAY, 1, "a"), (2, DAY, 2, "b")], "store_id long, date date, n int, v string")
    assert sorted(r.v for r in panel.keep_first(df, order_col="n").collect()) == ["a", "b"]
    assert panel.keep_first(df).count() == 2
    assert [(r.store_id, r.row_count) for r in panel.duplicate_keys(df).collect()] == [(1, 2)]
    assert panel.union_all([df, df.select("v", "n", "date", "store_id")]).count() == 6
    with pytest.raises(ValueError):
        panel.union_all([])


def test_store_limit_and_status(spark):
    schema = "store_id long, scan_type string, subcategory string"
    df = spark.createDataFrame(
        [(9, "GTIN", "Vaping Products"), (3, "NONSCAN", "Vaping Products"), (5, "GTIN", None), (5, None, "Vaping Products")],
        schema,
    )
    assert {r.store_id: r.status for r in prepare.store_status(df).collect()} == {
        9: "processed", 3: "no_gtin", 5: "no_subcategory",
    }
    assert {r.store_id for r in prepare.limit_stores(df, 2).collect()} == {3, 5}
    assert prepare.limit_stores(df, None) is df
    with pytest.raises(ValueError):
        prepare.limit_stores(df, -1)


def test_invalid_month_only_matters_in_kept_rows(spark):
    schema = "calendar_year int, calendar_month int, scan_type string"
    df = spark.createDataFrame([(2023, 99, "NONSCAN"), (2023, 1, "GTIN")], schema)
    assert [r.date for r in prepare.prepare_store(df).collect()] == [DAY]
