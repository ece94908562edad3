"""The given tables seen as the library's inputs.

``checks/sql_views.py`` states the same views in SQL.  All of them are derived
row by row from the given tables, so they grow with the data: a supplier is a
store, a brand is a product code, a line item is a sale, a customer's record is
a letter about a store of the same ZIP, an order is a reviewed match.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillmark.functions.calendar import FiscalCalendar

# The sales run from 1995 to 2001; both ends lie outside the fiscal window.
FISCAL = FiscalCalendar(7, dt.date(1996, 1, 1), dt.date(2000, 6, 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, words: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), index.cast("int") + 1)


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their product attributes (part is the only other table)."""
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("gtin"))
    # price after discount in units of 1/10000: whole numbers, so any sum is exact
    amount = F.rint(F.col("l_extendedprice") * 100) * (100 - F.rint(F.col("l_discount") * 100))
    # orders by (order, line, part) in one number that cannot overflow
    line_no = F.col("l_orderkey").cast("decimal(19,0)") * 8 + F.col("l_linenumber")
    row_no = (line_no * F.lit(10**12).cast("decimal(13,0)") + F.col("l_partkey")).cast("decimal(38,0)")
    line = line.select(
        "l_partkey",
        F.col("l_suppkey").alias("store_id"),
        F.year("l_shipdate").alias("calendar_year"),
        F.month("l_shipdate").alias("calendar_month"),
        F.when(F.col("l_returnflag") == "R", "NONSCAN").otherwise("GTIN").alias("scan_type"),
        F.col("l_quantity").alias("quantity"),
        amount.alias("amount"),
        (F.col("l_discount") > 0).alias("discounted"),
        row_no.alias("row_no"),
    )
    return line.join(part, F.col("l_partkey") == F.col("p_partkey"))


def _product_attributes(df: DataFrame) -> DataFrame:
    brand = F.substring("gtin", 7, 9).cast("int")
    return df.withColumns(
        {
            "product_type": F.when(brand % 5 > 0, F.concat(F.lit("Family "), brand % 5)),
            "subcategory": F.when(brand <= 20, "Vaping Products").otherwise("Other"),
        }
    )


def scanner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store x product x month x scan type, with every contract column."""
    keys = ["store_id", "gtin", "calendar_year", "calendar_month", "scan_type"]
    discounted = F.when(F.col("discounted"), F.col("quantity"))
    monthly = (
        _sales(spark, sf_dir)
        .groupBy(*keys)
        .agg(
            F.sum("quantity").alias("quantity"),
            F.coalesce(F.sum(discounted), F.lit(0.0)).alias("quantity_with_discount"),
            F.count(F.lit(1)).alias("transaction_count"),
            F.count_if("discounted").alias("transaction_count_with_discount"),
            (F.sum("amount") / 10000).alias("total_revenue_amount"),
        )
    )
    total = F.col("quantity") + F.col("quantity_with_discount")
    empty = F.lit(None).cast("string")
    return _product_attributes(monthly).withColumns(
        {
            "nonscan_category": empty,
            "nonscan_subcategory": empty,
            "nonscan_detail": empty,
            "category": F.lit("MERCHANDISE"),
            "manufacturer": empty,
            "brand": F.col("gtin"),
            "sub_product_type": empty,
            "unit_size": empty,
            "pack_size": empty,
            "product_description": empty,
            "q_plus_qwd": total,
            "unit_value_q_plus_qwd": F.col("total_revenue_amount") / total,
            "unit_value_q": F.col("total_revenue_amount") / F.col("quantity"),
        }
    )


def scanner_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sale: many rows share store, product and month."""
    revenue = F.col("amount") / 10000
    return (
        _product_attributes(_sales(spark, sf_dir))
        .withColumn("total_revenue_amount", revenue)
        .withColumn("unit_value_q", revenue / F.col("quantity"))
        .drop("l_partkey", "p_partkey", "amount", "discounted")
    )


def faulty_scanner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanner table with text in a count, missing values and a lost column."""
    gtin, count = F.col("gtin"), F.col("transaction_count")
    return (
        scanner(spark, sf_dir)
        .withColumns(
            {
                "gtin": F.when(gtin != "Brand#13", gtin),
                "transaction_count": F.when(count > 1, "many").otherwise(count.cast("string")),
                "quantity": F.when(F.col("calendar_month") != 7, F.col("quantity")),
            }
        )
        .drop("pack_size")
    )


def faulty_index(spark: SparkSession, sf_dir: str, label: str, kind: str = "price") -> DataFrame:
    """Scanner rows passed off as an index: negatives, infinities, duplicates."""
    store = F.col("store_id")
    shifted = F.col("unit_value_q") - 1500.0
    return scanner(spark, sf_dir).select(
        F.when(store % 9 > 0, store).alias("store_id"),
        F.make_date("calendar_year", "calendar_month", F.lit(1)).alias("date"),
        F.when(store % 10 == 0, F.lit(float("inf"))).otherwise(shifted).alias(f"{label}_{kind}_index"),
        F.when(store % 10 == 1, F.lit(float("-inf"))).otherwise(shifted).alias(f"l_{label}_{kind}_index"),
        F.lit("x").alias("note"),
    )


def patchy_scanner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some stores without product scans, some without the subcategory; every row is there."""
    store = F.col("store_id")
    bare, other = store % 7 == 0, (store % 7 != 0) & (store % 5 == 0)
    return scanner(spark, sf_dir).withColumns(
        {
            "scan_type": F.when(bare, "NONSCAN").otherwise(F.col("scan_type")),
            "subcategory": F.when(other, "Other").otherwise(F.col("subcategory")),
        }
    )


def _street(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street names by number, some with an accent."""
    accented = F.when(F.col("p_partkey") % 13 == 0, F.replace("p_name", F.lit("e"), F.lit("é")))
    name = F.coalesce(accented, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("street"))


def store_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw store file: ZIP+4 codes, missing ZIPs, suites (four stores per ZIP)."""
    key = F.col("s_suppkey")
    directions = ["North ", "", "SE ", "West "]
    suffixes = ["Street", "Avenue", "Ln", "Boulevard", "Drive", "Highway"]
    suite = F.when(key % 3 == 0, F.concat(F.lit(", Suite "), key % 9)).otherwise("")
    zip_code = F.concat(
        F.lpad((key / 4).cast("bigint").cast("string"), 5, "0"),
        F.when(key % 11 == 0, "-1234").otherwise(""),
    )
    address = F.concat(
        key % 90, F.lit(" "), _pick(key % 4, directions), "street", F.lit(" "),
        _pick(key % 6, suffixes), suite,
    )
    return (
        table(spark, sf_dir, "supplier")
        .join(_street(spark, sf_dir), key == F.col("p_partkey"))
        .select(
            key.alias("STORE_ID"),
            F.col("s_name").alias("STORE_NAME"),
            F.concat(F.lit("Chain "), F.col("s_nationkey")).alias("STORE_CHAIN_NAME"),
            address.alias("STREET_ADDRESS"),
            F.when(key % 17 != 0, zip_code).alias("ZIP_CODE"),
        )
    )


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw letter file: quoted and missing ZIPs, online shops, loose spelling."""
    key = F.col("c_custkey")
    area = (key / 60).cast("bigint")
    store = area * 4 + key % 4
    directions = ["North ", "", "S.E. ", "W. "]
    suffixes = ["St.", "Ave", "Lane", "Blvd.", "Dr.", "Hwy"]
    suite = F.when(key % 10 == 3, " Suite 4").otherwise("")
    zip_code = F.lpad(area.cast("string"), 5, "0")
    kind = F.when(key % 10 == 0, "Online").when(key % 10 == 1, "online").otherwise(" Retail ")
    inspected = F.date_add(F.lit(dt.date(2000, 1, 1)), (key % 700).cast("int"))
    address = F.concat(
        store % 90 + key % 3, F.lit(" "), _pick(key % 4, directions), "street", F.lit("  "),
        _pick(store % 6, suffixes), suite,
    )
    return (
        table(spark, sf_dir, "customer")
        .withColumn("near", store)
        .join(_street(spark, sf_dir), F.col("near") == F.col("p_partkey"))
        .select(
            kind.alias("Type"),
            inspected.alias("Inspected"),
            F.when(key % 6 > 0, F.date_add(inspected, 60)).alias("Issued"),
            F.col("c_name").alias("Name"),
            address.alias("Address"),
            F.concat(F.lit("City "), F.col("c_nationkey")).alias("City"),
            F.lit("ST").alias("State"),
            F.when(key % 23 == 0, F.lit(None).cast("string"))
            .when(key % 7 == 0, F.concat(F.lit('"'), zip_code, F.lit('"')))
            .otherwise(zip_code)
            .alias("Zip"),
            F.col("c_mktsegment").alias("Products"),
        )
    )


def reviewed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed candidate rows: inspection and issue dates with a 0/1 verdict."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    inspected = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") / 15).cast("bigint").alias("store_id"),
        inspected.alias("insp_date"),
        F.when(F.col("o_orderstatus") != "O", F.date_add(inspected, 60)).alias("issue_date"),
        F.when(urgent, 1).otherwise(0).alias("matching"),
    )
