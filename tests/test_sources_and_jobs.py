from __future__ import annotations

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from checks import views
from tests.test_index import tiny_raw
from tillmark.__main__ import main
from tillmark.operators import prepare, price_index
from tillmark.plans import jobs
from tillmark.sources import readers
from tillmark.sources.sinks import with_timestamps, write_index_per_store

SF = "/root/testdata/sf0.001"


def store_file(folder, store, months, scan="GTIN"):
    """A raw per-store file with upper-case names, as the scanner export has them."""
    n = len(months)
    table = {
        name: pa.array([None] * n, pa.string())
        for name in readers.store_schema(upper=True).names
    }
    table |= {
        "STORE_ID": [store] * n, "CALENDAR_YEAR": [2023] * n, "CALENDAR_MONTH": months,
        "GTIN": ["A"] * n, "SCAN_TYPE": [scan] * n, "SUBCATEGORY": ["Vaping Products"] * n,
        "PRODUCT_TYPE": ["Pods"] * n, "TRANSACTION_COUNT": [1] * n,
        "TRANSACTION_COUNT_WITH_DISCOUNT": [0] * n,
        "UNIT_VALUE_Q_PLUS_QWD": [1.0] * n, "UNIT_VALUE_Q": [2.0 ** m for m in months],
    }
    for name in ("QUANTITY", "QUANTITY_WITH_DISCOUNT", "TOTAL_REVENUE_AMOUNT", "Q_PLUS_QWD"):
        table[name] = [10.0] * n
    pq.write_table(pa.table(table), os.path.join(folder, f"{store}.parquet"))


def test_store_scan_with_declared_schema_and_names(spark, tmp_path):
    for store in (7, 8, 9):
        store_file(tmp_path, store, [1, 2, 3], "GTIN" if store < 9 else "NONSCAN")
    df = readers.read_store_table(spark, str(tmp_path), schema=readers.store_schema(upper=True), file_id="file_store")
    assert df.count() == 9 and {r.file_store for r in df.select("file_store").distinct().collect()} == {"7", "8", "9"}
    kept = df.filter("SCAN_TYPE = 'GTIN' AND STORE_ID > 7").select("STORE_ID", "CALENDAR_MONTH")
    assert sorted(map(tuple, kept.collect())) == [(8, 1), (8, 2), (8, 3)]
    assert dict(df.dtypes)["BRAND"] == "string"


def test_store_number_from_a_parquet_file_name(spark, tmp_path):
    for store in (28380, 7):
        pq.write_table(pa.table({"x": [1, 2]}), str(tmp_path / f"{store}.snappy.parquet"))
    df = readers.read_store_table(spark, str(tmp_path), file_id="store")
    assert sorted(r.store for r in df.collect()) == ["28380", "28380", "7", "7"]
    assert readers.read_if_present(spark, str(tmp_path / "none")) is None
    assert readers.read_if_present(spark, None) is None


def test_index_per_store(spark, tmp_path):
    index = price_index.geo_index(
        prepare.filter_subcategory(prepare.prepare_store(views.scanner(spark, SF), views.FISCAL)),
        unique_months=True,
    )
    write_index_per_store(with_timestamps(index), str(tmp_path / "f"))
    names = {n for n in os.listdir(tmp_path / "f") if n.startswith("store_id=")}
    assert names == {f"store_id={r.store_id}" for r in index.select("store_id").distinct().collect()}
    assert dict(spark.read.parquet(str(tmp_path / "f")).dtypes)["date"] == "timestamp"
    write_index_per_store(index, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == index.count()


@pytest.mark.parametrize("preset", sorted(jobs.PRESETS))
def test_index_job_presets(spark, tmp_path, preset):
    for store in (7, 8, 9, 10):
        store_file(tmp_path, store, [1, 2, 3], "GTIN" if store != 9 else "NONSCAN")
    out = str(tmp_path / "out")
    raw = readers.read_store_table(spark, str(tmp_path), schema=readers.store_schema(upper=True))
    kind, basis = jobs.PRESETS[preset].index_kind, jobs.PRESETS[preset].weight_basis
    panel = jobs.index_job(spark, raw, out, kind, basis, limit=3)
    rows = sorted((r.store_id, r.date.month, r[2]) for r in panel.collect())
    step = 2.0 if kind == "price" else 1.0
    assert rows == [(s, m, None if m == 1 else step) for s in (7, 8) for m in (1, 2, 3)]
    status = {r.store_id: r.status for r in spark.read.parquet(f"{out}/store_status").collect()}
    assert status == {7: "processed", 8: "processed", 9: "no_gtin"}
    assert os.path.isdir(f"{out}/index_panels/{jobs.output_name(kind, basis)}")


def test_index_job_contract_modes_and_empty_input(spark, tmp_path):
    bad = tiny_raw(spark).withColumn("QUANTITY", F.lit(None).cast("double"))
    with pytest.raises(ValueError, match="quantity: not_null x3"):
        jobs.index_job(spark, bad, str(tmp_path / "a"))
    panel = jobs.index_job(spark, bad, str(tmp_path / "b"), contract="report")
    assert panel.count() == 3
    report = prepare.total_violations(spark.read.parquet(str(tmp_path / "b/store_status")))
    assert [tuple(r) for r in report.filter("violations > 0").collect()] == [("quantity", "not_null", 3)]
    with pytest.raises(RuntimeError, match="No store-level index rows"):
        jobs.index_job(spark, tiny_raw(spark).filter("false"), str(tmp_path / "c"))


def test_match_and_treatment_jobs_from_files(spark, tmp_path):
    folder = tmp_path / "letters"
    folder.mkdir()
    header = "a,b,c,d,e,f,g,h,i\n"
    (folder / "2023-announcement.csv").write_text(header + 'Retail,2023-03-05,2023-05-01,Shop,"12 Main St., Suite 2",X,Y,00012,vapor\n')
    (folder / "2024-announcement.csv").write_text(header + "Online,2024-01-05,,Web,1 Net,X,Y,00012,vapor\n")
    (folder / "other.csv").write_text("zzz\n")
    (tmp_path / "stores.csv").write_text(
        "STORE_ID,STORE_NAME,STORE_CHAIN_NAME,STREET_ADDRESS,ZIP_CODE\n"
        "1,One,N/A,12 Main Street,00012\n2,Two,C,9 Elm Road,00099\n"
    )
    letters = readers.read_letters_csv(spark, str(folder))
    stores = readers.read_store_master(spark, str(tmp_path / "stores.csv"))
    result = jobs.match_job(spark, stores, letters, str(tmp_path / "out"))
    assert (result["letters"], result["pairs"]) == (1, 2)
    assert result["summary"]["max"] == 100 and result["top"][0]["store_id"] == 1
    sheet = spark.read.option("header", True).csv(str(tmp_path / "out" / "warning_letters_matched"))
    first = sheet.first()
    assert (first.store_id, first.similarity_score, first.store_chain_name_pdi) == ("1", "100", "nan")

    level, log = price_index.index_columns("qty")
    index = spark.createDataFrame([(1, dt.date(2023, 3, 1), 1.0, 0.0)], f"store_id long, date date, {level} double, {log} double")
    marked = sheet.withColumn("matching", F.when(F.col("similarity_score") > 90, 1).otherwise(0))
    marked.write.option("header", True).csv(str(tmp_path / "reviewed"))
    reviewed = readers.read_reviewed_sheet(spark, str(tmp_path / "reviewed"))
    kinds = dict(reviewed.dtypes)
    assert (kinds["store_id"], kinds["insp_date"], kinds["matching"], kinds["zip_code"]) == ("bigint", "date", "int", "string")
    counts = jobs.treatment_job(spark, index, reviewed, str(tmp_path / "out"))
    assert counts == {"rows": 1, "store_months": 1, "insp_rows": 1, "issue_rows": 1}
    with pytest.raises(ValueError, match="No warning letters"):
        readers.read_letters_csv(spark, str(folder), glob="*nothing*")


def test_validate_job_and_command_line(spark, tmp_path, capsys, monkeypatch):
    assert jobs.validate_job() == {"store": "skipped", "index": "skipped"}
    assert jobs.validate_job(store_rows=tiny_raw(spark))["store"] == "valid"
    raw = tmp_path / "raw"
    tiny_raw(spark).write.parquet(str(raw))
    main(["index", "--store-path", str(raw), "--out", str(tmp_path / "out"), "--preset", "qty_calendar", "--per-store"])
    main(["validate", "--store", str(raw), "--index", str(tmp_path / "missing")])
    shown = capsys.readouterr().out
    assert "panel rows: 3" in shown and "'index': 'skipped'" in shown


@pytest.mark.parametrize("cells", [8, 10])
def test_letter_files_of_another_width_fail(spark, tmp_path, cells):
    head = ",".join("abcdefghi") + "\n"
    (tmp_path / "x-announcement.csv").write_text(head + ",".join(["2023-01-01"] * cells) + "\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        # not even a single column can be read
        readers.read_letters_csv(spark, str(tmp_path)).select("city").collect()


def test_cells_with_line_breaks_and_other_dates(spark, tmp_path):
    head = ",".join("abcdefghi") + "\n"
    (tmp_path / "x-announcement.csv").write_text(head + 'Retail,05/03/2023,,Shop,"12 Main St.\nSuite 2",X,Y,00012,vapor\n')
    row = readers.read_letters_csv(spark, str(tmp_path), "dd/MM/yyyy", multi_line=True).collect()
    assert [(r.insp_date, r.address) for r in row] == [(dt.date(2023, 3, 5), "12 Main St.\nSuite 2")]
    (tmp_path / "stores.csv").write_text('STORE_ID,STREET_ADDRESS\n1,"a\nb"\n')
    stores = readers.read_store_master(spark, str(tmp_path / "stores.csv"), multi_line=True)
    assert [r.STREET_ADDRESS for r in stores.collect()] == ["a\nb"]


@pytest.mark.parametrize("limit", [None, 2])
def test_index_job_reads_the_raw_table_twice(spark, tmp_path, limit):
    for store in (7, 8, 9):
        store_file(tmp_path, store, [1, 2, 3])
    raw = readers.read_store_table(spark, str(tmp_path / "*.parquet"), schema=readers.store_schema(upper=True))
    seen = []
    real = jobs.write_table

    def counting(df, path, fmt="parquet"):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString().count("CALENDAR_YEAR#") > 0)
        return real(df, path, fmt)

    jobs.write_table = counting
    try:
        panel = jobs.index_job(spark, raw, str(tmp_path / "out"), limit=limit)
    finally:
        jobs.write_table = real
    # status and kept rows; a dry run reads the ids once before
    assert sum(seen) == (2 if limit is None else 3)
    assert panel.select("store_id").distinct().count() == (limit or 3)


def test_limit_takes_no_place_for_missing_ids(spark):
    df = spark.createDataFrame([(None,), (3,), (1,), (2,)], "store_id long")
    assert {r.store_id for r in prepare.limit_stores(df, 2).collect()} == {1, 2}


def test_whole_number_codes_are_plain_digits(spark):
    from tillmark.operators.contracts import STORE_CONTRACT

    df = spark.createDataFrame([(12345678901234.0,), (1.5,), (None,), (float("nan"),)], "gtin double")
    assert [r.gtin for r in STORE_CONTRACT.coerce(df).collect()] == ["12345678901234", "1.5", None, None]


def test_an_invalid_month_fails_in_the_jobs(spark, tmp_path):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    bad = tiny_raw(spark).withColumn("CALENDAR_MONTH", F.lit(13).cast("long"))
    with pytest.raises(Exception, match="(?i)month"):
        jobs.index_job(spark, bad, str(tmp_path / "a"))
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
