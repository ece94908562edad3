"""What the plans must look like: shuffles, pushdown, pruning, skew splitting."""

from __future__ import annotations

import contextlib
import re

import pytest
from pyspark.sql import functions as F

from tests.test_index import tiny_raw
from tests.test_matching_and_treatment import letters, stores
from tillmark.functions.text import normalise_address
from tillmark.operators import lags, matching, panel, prepare, price_index, treatment, weights
from tillmark.operators.contracts import STORE_CONTRACT
from tillmark.sources.sinks import write_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", re.sub(r"#\d+L?", "", plan(df)))


@contextlib.contextmanager
def settings(spark, **conf):
    keys = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


NO_BROADCAST = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
}
SMALL_SKEW = NO_BROADCAST | {
    "spark__sql__shuffle__partitions": "32",
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "4KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "4KB",
}


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """48,000 rows over 41 stores, half of them in store 0."""
    i = F.col("id")
    series = F.floor(i / 24)
    month = (i % 24).cast("int")
    df = spark.range(48000).select(
        F.when(series % 2 == 0, 0).otherwise(1 + series % 80 / 2).cast("long").alias("store_id"),
        F.concat(F.lit("g"), series).alias("gtin"),
        F.lit("Vaping Products").alias("subcategory"),
        F.concat(F.lit("t"), series % 3).alias("product_type"),
        F.add_months(F.lit("2022-01-01").cast("date"), month).alias("date"),
        (F.lit(2022) + F.floor(month / 12)).cast("int").alias("calendar_year"),
        (F.lit(2022) + F.floor((month + 6) / 12)).cast("int").alias("fiscal_year"),
        (1 + i % 7).cast("double").alias("unit_value_q"),
        (1 + i % 5).cast("double").alias("quantity"),
        (i % 11).cast("double").alias("total_revenue_amount"),
    )
    return write_table(df.repartition(6), str(tmp_path_factory.mktemp("rows") / "t"))


def test_index_shuffles_rows_once_when_type_weights_are_stored(spark, rows, tmp_path):
    stored = write_table(weights.type_weight_table(rows, "fiscal_year"), str(tmp_path / "w"))
    index = price_index.geo_index(rows, unique_months=True, type_weights=stored)
    assert shuffles(index) == [
        "store_id, subcategory, date",
        "store_id, subcategory, product_type, date",
        "store_id, gtin",
        # only rows without store or product, combined before they move
        "store_id, subcategory, product_type, gtin, fiscal_year, date",
    ]
    assert "BroadcastHashJoin" in plan(index) and "Python" not in plan(index)
    text = plan(index)
    # both later shuffles carry partial products, not rows
    assert text.count("partial_product") == 2


def moved(df):
    """Columns of every exchange that carries single months of single products."""
    found = re.findall(r"Exchange hashpartitioning\(.*?\n(.*?)\n", re.sub(r"#\d+L?", "", plan(df)))
    return [line for line in found if "opening" in line or "unit_value_q" in line]


@pytest.mark.parametrize("stored", [False, True])
def test_index_moves_rows_once_at_every_weight_table_size(spark, rows, tmp_path, stored):
    given = write_table(weights.type_weight_table(rows, "fiscal_year"), str(tmp_path / "w")) if stored else None
    plain = {tuple(r)[:2]: r[2] for r in price_index.geo_index(rows, unique_months=True, type_weights=given).collect()}
    with settings(spark, **NO_BROADCAST):
        index = price_index.geo_index(rows, unique_months=True, type_weights=given)
        assert len(moved(index)) == 1 and "Broadcast" not in plan(index)
        # the weights join the rows of a series where its window left them
        join = re.search(r"SortMergeJoin \[store_id, gtin\].*?\n(.*?)Window", re.sub(r"#\d+L?", "", plan(index)), re.S)
        assert "Exchange" not in join.group(1)
        in_place = {tuple(r)[:2]: r[2] for r in index.collect()}
    assert in_place.keys() == plain.keys() and len(plain) > 500
    assert all(v == (in_place[k] and pytest.approx(in_place[k], rel=1e-9)) for k, v in plain.items())


def test_copies_are_combined_before_they_are_shuffled(spark, rows):
    index = price_index.geo_index(rows, order_col="quantity")
    first = "store_id, subcategory, product_type, gtin, fiscal_year, date"
    assert first in shuffles(index)
    text = plan(index)
    assert "partial_min_by" in text and "SortAggregate" not in text


def formatted(df):
    mode = "formatted"
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_index_reads_only_its_columns(spark, rows):
    text = formatted(price_index.geo_index(rows, "calendar", "qty", unique_months=True))
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    # series, products, rows without store or product, and the weights for each of the last two
    assert len(scans) == 5
    assert all("unit_value_q" not in s and "fiscal_year" not in s for s in scans)


def test_filters_reach_the_parquet_scan(spark, tmp_path):
    raw = write_table(tiny_raw(spark), str(tmp_path / "raw"))
    kept = STORE_CONTRACT.coerce(prepare.filter_subcategory(prepare.prepare_store(raw)))
    text = formatted(kept.select("store_id", "date"))
    assert "EqualTo(SCAN_TYPE,GTIN)" in text and "EqualTo(SUBCATEGORY,Vaping Products)" in text
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {
        "STORE_ID", "CALENDAR_YEAR", "CALENDAR_MONTH", "SCAN_TYPE", "SUBCATEGORY",
    }


def test_reductions_are_partial_before_the_shuffle(spark, rows):
    for df in (
        weights.revenue_weights(rows, "fiscal_year").product,
        panel.duplicate_keys(rows),
        panel.keep_first(rows.select("store_id", "date", "quantity"), order_col="quantity"),
        prepare.store_status(rows.withColumn("scan_type", F.lit("GTIN"))),
    ):
        text = plan(df)
        assert text.count("Aggregate(key") == 2 and len(shuffles(df)) == 1


def test_unique_lags_take_one_shuffle(spark, rows):
    out = lags.value_lags(rows, "unit_value_q", unique_months=True)
    assert shuffles(out) == ["store_id, gtin"]


def test_address_cleaning_is_native(spark):
    df = spark.createDataFrame([("é",)], "a string").select(normalise_address(F.col("a")))
    assert "Python" not in plan(df)


def test_one_python_step_scores_the_pairs(spark):
    s = matching.prep_stores(stores(spark, [(1, "1 Oak", "1")]))
    ls = matching.prep_letters(letters(spark, [("r", "1 Oak", "1")]))
    assert plan(matching.match_candidates(s, ls)).count("ArrowEvalPython") == 1


def test_each_side_of_the_match_is_cleaned_and_moved_once(spark, tmp_path):
    raw = stores(spark, [(i, f"{i} Oak Street", None if i % 5 == 0 else f"{i % 7}") for i in range(40)])
    s = matching.prep_stores(write_table(raw, str(tmp_path / "s")))
    ls = matching.prep_letters(write_table(letters(spark, [("r", f"{i} Oak", f"{i % 4}") for i in range(40)]), str(tmp_path / "l")))
    with settings(spark, **NO_BROADCAST):
        found = matching.match_candidates(s, ls)
        text = re.sub(r"#\d+L?", "", plan(found))
        # stores with and without a ZIP, and letters; the ZIPs alone are read again
        scans = re.findall(r"FileScan parquet \[(.*?)\]", text)
        assert sorted(scans) == sorted(["ZIP_CODE", "a,h", "a,b,c,d,e,h"] + 2 * [",".join(raw.columns)])
        # four shuffles by ZIP: two of rows, two of distinct ZIPs, and one by words
        assert text.count("Exchange hashpartitioning(zip_code") == 4 and text.count("Exchange") == 5
        rows = found.collect()
    assert len(rows) == 8 + 32 + sum(9 if i % 7 < 4 else 0 for i in range(40) if i % 5)


def test_top_list_is_not_a_full_sort(spark):
    df = spark.range(5).select(F.col("id").cast("int").alias("similarity_score"))
    assert "TakeOrderedAndProject" in plan(matching.top_candidates(df, 2))


def test_limit_list_is_a_bounded_top_n(spark, rows):
    assert "TakeOrderedAndProject" in plan(prepare.limit_stores(rows, 3))


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan(df)


def test_a_hot_store_is_split_in_the_weight_join(spark, rows):
    with settings(spark, **SMALL_SKEW):
        index = price_index.geo_index(rows, unique_months=True)
        assert "skew=true" in final_plan(index)
        split = {tuple(r) for r in index.collect()}
    plain = {tuple(r) for r in price_index.geo_index(rows, unique_months=True).collect()}
    rounded = [sorted((s, d, round(x, 9) if x else x) for s, d, x, _ in t) for t in (split, plain)]
    assert rounded[0] == rounded[1] and len(plain) > 500


def test_a_hot_zip_is_split_in_the_candidate_join(spark):
    s = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("zip_code"),
        F.col("id").alias("store_id"), F.lit("1 Oak").alias("address"),
        F.lit("n").alias("store_name"), F.lit("c").alias("store_chain_name_pdi"),
    ).repartition(6)
    ls = spark.range(40).select(
        F.when(F.col("id") < 4, "hot").otherwise(F.col("id").cast("string")).alias("zip_code"),
        F.lit("1 Oak").alias("address"), F.lit("l").alias("store_name"),
        F.current_date().alias("insp_date"), F.current_date().alias("issue_date"),
    )
    with settings(spark, **SMALL_SKEW):
        pairs = matching.zip_candidates(s, ls)
        assert "skew=true" in final_plan(pairs)
        assert pairs.count() == 1500 * 4 + 1500
        number = F.col("id")
        crowd = spark.range(3000).select(
            F.when(number % 2 == 0, "hot").otherwise(number.cast("string")).alias("zip_code"),
            F.sha2(number.cast("string"), 256).alias("address"), F.lit("l").alias("store_name"),
            F.current_date().alias("insp_date"), F.current_date().alias("issue_date"),
        ).repartition(6)
        pairs = matching.zip_candidates(s.filter("store_id < 60"), crowd)
        assert "skew=true" in final_plan(pairs)
        assert pairs.count() == 30 * 1500 + 30


def test_a_zip_of_many_pairs_is_joined_by_several_tasks(spark):
    s = matching.prep_stores(
        spark.range(2300).select(
            F.col("id").alias("STORE_ID"), F.lit("n").alias("STORE_NAME"), F.lit("c").alias("STORE_CHAIN_NAME"),
            F.lit("1 Oak").alias("STREET_ADDRESS"), F.lit(None).cast("string").alias("ZIP_CODE"),
        ),
        null_zip="join",
    )
    ls = spark.range(2300).select(
        F.lit("nan").alias("zip_code"), F.lit("1 Oak").alias("address"), F.lit("l").alias("store_name"),
        F.current_date().alias("insp_date"), F.current_date().alias("issue_date"),
    )
    with settings(spark, spark__sql__shuffle__partitions="64"):
        pairs = matching.zip_candidates(s, ls).withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in pairs.groupBy("part").count().collect()]
    # few bytes and 5 million pairs, in four lots
    assert sum(sizes) == 2300 * 2300 and len(sizes) > 1 and max(sizes) < 0.8 * sum(sizes)


def test_many_letters_of_one_small_file_are_cleaned_by_several_tasks(spark):
    raw = spark.range(40_000, numPartitions=1).select(
        F.lit("r").alias("a"), F.current_date().alias("b"), F.current_date().alias("c"), F.lit("n").alias("d"),
        F.concat("id", F.lit(" Oak")).alias("e"), F.lit("c").alias("f"), F.lit("s").alias("g"),
        F.lit("1").alias("h"), F.lit("p").alias("i"),
    )
    s = matching.prep_stores(stores(spark, [(1, "1 Oak", "1")]))
    ours, theirs = matching._prepared_sides(s, matching.prep_letters(raw), matching.SUFFIXES)
    parts = theirs.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(parts) > 1 and max(r["n"] for r in parts) < 20_000 and sum(r["n"] for r in parts) == 40_000
    assert "Exchange" not in plan(ours)


def test_a_hot_month_is_split_in_the_lag_join(spark, rows):
    copies = rows.withColumn("gtin", F.when(F.col("store_id") == 0, "g0").otherwise(F.col("gtin")))
    copies = copies.withColumn("date", F.when(F.col("store_id") == 0, F.lit("2022-01-01").cast("date")).otherwise(F.col("date")))
    copies = copies.withColumn("at", F.monotonically_increasing_id())
    with settings(spark, **SMALL_SKEW):
        out = lags.value_lags(copies, "unit_value_q", order_col="at")
        assert "skew=true" in final_plan(out)
        assert out.filter("store_id = 0 AND month_diff IS NULL").count() == 1
        assert out.filter("store_id = 0 AND month_diff = 0").count() == 23999


def test_copies_of_one_partition_are_written_by_several_tasks(spark):
    one = spark.range(1_000_000, numPartitions=1).select(
        F.lit(1).cast("long").alias("store_id"), F.lit("g").alias("gtin"), F.lit("2022-01-01").cast("date").alias("date"),
        F.lit(2.0).alias("unit_value_q"),
    )
    out = lags.value_lags(one, "unit_value_q").withColumn("part", F.spark_partition_id())
    sizes = {r["part"]: r["count"] for r in out.groupBy("part").count().collect()}
    assert sum(sizes.values()) == 1_000_000 and len(sizes) > 2 and max(sizes.values()) < 600_000
    assert out.where("month_diff is null").count() == 1


def test_treatment_side_is_reduced_before_its_join(spark, rows):
    index = price_index.geo_index(rows, unique_months=True)
    reviewed = rows.select("store_id", F.col("date").alias("insp_date"), F.col("date").alias("issue_date"))
    with settings(spark, **NO_BROADCAST):
        keys = shuffles(treatment.assign_treatment(index, reviewed))
    assert any("insp_date, issue_date" in k for k in keys)


def test_lags_combine_no_whole_rows_unless_they_tie(spark, rows):
    """Only rows that share their month's first value are grouped by all their columns."""
    wide = rows.withColumn("note", F.concat(F.lit("n"), "gtin"))
    text = re.sub(r"#\d+L?", "", plan(lags.value_lags(wide, "unit_value_q")))
    grouped = re.findall(r"HashAggregate\(keys=\[(.*?)\], functions=\[(.*?)\]", text)
    assert any("note" in keys for keys, _ in grouped)
    # what the months are reduced with: fixed-width buffers over the month's key alone
    reduced = [keys for keys, functions in grouped if "max(" in functions]
    assert reduced and all("note" not in keys for keys in reduced)
    # whole rows are only grouped after the join with their months has told ties from the rest
    assert all("__gap" in keys for keys, _ in grouped if "note" in keys)


def test_ties_for_the_first_place_are_settled_by_the_other_columns(spark):
    month = "2022-0{}-01"
    data = [("a", month.format(1), "9", "x")] + [("a", month.format(2), v, n) for v, n in
            [("5", "c"), ("5", "b"), ("5", "b"), ("5.0", "b"), ("5", "b"), ("7", "a"), ("7", "a")]] + [("a", None, "1", "z")] * 2
    df = spark.createDataFrame([(1, *r) for r in data], "store_id int, gtin string, date string, v string, note string")
    out = lags.value_lags(df.withColumn("date", F.to_date("date")), "v")
    got = sorted((r.note, r.v, r.month_diff, r.lag_value) for r in out.where("month(date) = 2").collect() if r.month_diff)
    assert got == [("b", "5", 1, 9.0)]
    assert out.count() == len(data)
    assert [(r.month_diff, r.lag_value) for r in out.where("date is null").collect()] == [(0, None)] * 2
