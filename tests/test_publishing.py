"""Outputs that other runs rely on: per-store folders, panels, counted writes, scratch tables."""

from __future__ import annotations

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import DataFrame, functions as F

from tests.test_matching_and_treatment import letters, stores
from tests.test_sources_and_jobs import store_file
from tillmark.__main__ import main
from tillmark.operators import matching, panel, price_index
from tillmark.operators.contracts import ContractError
from tillmark.plans import jobs
from tillmark.sources import readers
from tillmark.sources.scratch import run_folder, shared_dir, stored
from tillmark.sources.sinks import write_index_per_store

LEVEL, LOG = price_index.index_columns("price")
INDEX = f"store_id long, date date, {LEVEL} double, {LOG} double"


def month(m):
    return dt.date(2023, m, 1)


def files(folder):
    return {n: sorted(os.listdir(folder / n)) for n in os.listdir(folder) if n.startswith("store_id=")}


def raw_stores(spark, folder):
    return readers.read_store_table(spark, str(folder), schema=readers.store_schema(upper=True))


def test_a_limited_rerun_replaces_only_its_own_stores(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    for store in range(7, 12):
        store_file(tmp_path / "raw", store, [1, 2, 3])
    out = str(tmp_path / "out")
    jobs.index_job(spark, raw_stores(spark, tmp_path / "raw"), out, per_store=True)
    folder = tmp_path / "out" / "store_vape_price_indexes_fiscal"
    full = files(folder)
    assert len(full) == 5
    store_file(tmp_path / "raw", 7, [1, 2])
    jobs.index_job(spark, raw_stores(spark, tmp_path / "raw"), out, per_store=True, limit=2)
    again = files(folder)
    assert again.keys() == full.keys()
    assert {n for n in full if again[n] != full[n]} == {"store_id=7", "store_id=8"}
    rows = spark.read.parquet(str(folder)).groupBy("store_id").count().collect()
    assert {r["store_id"]: r["count"] for r in rows} == {7: 2, 8: 3, 9: 3, 10: 3, 11: 3}


def test_a_panel_of_the_stores_that_several_runs_wrote(spark, tmp_path, capsys):
    first = spark.createDataFrame([(1, month(1), 1.0, 0.0), (2, month(1), 2.0, 0.7)], INDEX)
    second = spark.createDataFrame([(2, month(1), 3.0, 1.1), (2, month(2), None, None), (3, month(1), 1.0, 0.0)], INDEX)
    folder = str(tmp_path / "stores")
    write_index_per_store(first, folder)
    write_index_per_store(second, folder)
    main(["panel", "--store-index", folder, "--out", str(tmp_path / "panel")])
    assert "panel rows: 4" in capsys.readouterr().out
    rows = spark.read.parquet(str(tmp_path / "panel"))
    assert dict(rows.dtypes)["store_id"] == "bigint"
    assert sorted((r[0], r[1].month, r[2]) for r in rows.collect()) == [(1, 1, 1.0), (2, 1, 3.0), (2, 2, None), (3, 1, 1.0)]


def test_the_first_row_in_file_order_stays(spark, tmp_path):
    rows = spark.createDataFrame([(1, month(1), float(9 - i), 0.0) for i in range(9)], INDEX)
    rows.coalesce(1).write.parquet(str(tmp_path / "index"))
    built = jobs.panel_job(spark, str(tmp_path / "index"), str(tmp_path / "panel"))
    assert [tuple(r) for r in built.collect()] == [(1, month(1), 9.0, 0.0)]
    # without file order the choice does not depend on chance
    given = rows.repartition(4).union(rows.repartition(3))
    assert [r[LEVEL] for r in panel.keep_first(given).collect()] == [1.0]


def test_a_broken_panel_does_not_replace_the_earlier_one(spark, tmp_path):
    path = str(tmp_path / "panel")
    good = spark.createDataFrame([(1, month(1), 1.0, 0.0), (1, month(1), 1.0, 0.0)], INDEX)
    assert jobs.build_panel(good, path).count() == 1
    bad = spark.createDataFrame([(1, month(1), -1.0, 0.0), (None, month(2), float("inf"), 0.0)], INDEX)
    with pytest.raises(ContractError, match=f"store_id: not_null x1; {LEVEL}: at_least_0 x1; {LEVEL}: finite x1"):
        jobs.build_panel(bad, path)
    with pytest.raises(RuntimeError, match="No store-level index rows"):
        jobs.build_panel(good.where("false"), path)
    with pytest.raises(ContractError, match="note: extra_column"):
        jobs.build_panel(good.withColumn("note", F.lit(1)), path)
    assert spark.read.parquet(path).count() == 1 and os.listdir(tmp_path) == ["panel"]
    assert jobs.build_panel(good.withColumn("store_id", F.lit(5).cast("long")), path).first().store_id == 5
    assert os.listdir(tmp_path) == ["panel"]


def counting_rows(spark, df):
    """``df`` and an accumulator of how many of its rows were computed."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def test_a_panel_reads_its_index_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, month(1 + i % 12), 1.0, 0.0) for i in range(50)], INDEX)
    watched, seen = counting_rows(spark, rows)
    assert jobs.build_panel(watched, str(tmp_path / "panel")).count() == 50
    assert seen.value == 50


def test_jobs_count_rows_while_they_write_them(spark, tmp_path, monkeypatch):
    s = stores(spark, [(i, f"{i} Oak Street", f"0000{i % 3}") for i in range(9)])
    ls = letters(spark, [("r", f"{i} Oak St.", f"0000{i % 2}") for i in range(6)])
    expected = matching.match_candidates(matching.prep_stores(s), matching.prep_letters(ls))
    summary = matching.score_summary(expected).first().asDict()
    ranked = [tuple(r) for r in matching.rank_candidates(expected).collect()]

    def forbidden(self):
        raise AssertionError("a pass of its own for a row count")

    with monkeypatch.context() as patch:
        patch.setattr(type(s), "count", forbidden)
        patch.setattr(type(s), "isEmpty", forbidden)
        result = jobs.match_job(spark, s, ls, str(tmp_path / "out"), preview=4)
    assert (result["letters"], result["pairs"]) == (6, len(ranked)) == (6, 21)
    assert result["summary"] == pytest.approx(summary)
    assert [r["similarity_score"] for r in result["top"]] == [r[-1] for r in ranked[:4]]
    sheet = spark.read.option("header", True).csv(str(tmp_path / "out" / "warning_letters_matched"))
    assert sheet.count() == 21
    with pytest.raises(ValueError, match="No warning letters"):
        jobs.match_job(spark, s, ls.where("false"), str(tmp_path / "none"))


def test_treatment_counts_come_with_the_write(spark, tmp_path, monkeypatch):
    index = spark.createDataFrame([(1, month(3), 1.0, 0.0), (1, month(4), 1.0, 0.0), (2, month(3), 1.0, 0.0)], INDEX)
    reviewed = spark.createDataFrame(
        [(1, month(3), month(5), 1), (1, month(3), month(6), 1), (2, month(3), None, 1), (2, month(4), None, 0)],
        "store_id long, insp_date date, issue_date date, matching int",
    )
    with monkeypatch.context() as patch:
        patch.setattr(DataFrame, "count", None)
        counts = jobs.treatment_job(spark, index, reviewed, str(tmp_path))
    assert counts == {"rows": 4, "store_months": 3, "insp_rows": 3, "issue_rows": 2}
    assert jobs.treatment_job(spark, index.where("false"), reviewed, str(tmp_path / "none"))["rows"] == 0


def test_letter_rows_of_another_form_are_listed(spark, tmp_path, capsys):
    head = ",".join("abcdefghi") + "\n"
    good = 'Retail,2023-03-05,,Shop,"1, Oak",X,Y,00012,vapor\n'
    (tmp_path / "a-announcement.csv").write_text(head + good + "Retail,2023-03-05,,Shop,1 Oak,X,Y,00012\n")
    (tmp_path / "b-announcement.csv").write_text(
        head + "Retail,2023-03-05,,Shop,1 Oak,X,Y,00012,v,more\n" + good.replace("2023-03-05", "March 5") + good
    )
    found = readers.letter_violations(spark, str(tmp_path))
    assert found.columns == ["file", "rule", "column", "value", "row"]
    rows = sorted(map(tuple, found.collect()))
    assert [r[:4] for r in rows] == [
        ("a-announcement.csv", "cells", "store_type", "Retail"), ("b-announcement.csv", "cells", "store_type", "Retail"),
        ("b-announcement.csv", "date", "insp_date", "March 5"),
    ]
    assert rows[0][4] == "Retail,2023-03-05,,Shop,1 Oak,X,Y,00012" and rows[1][4].endswith(",v,more")
    left = readers.read_letters_csv(spark, str(tmp_path), malformed="leave-out")
    assert sorted(str(r.insp_date) for r in left.collect()) == ["2023-03-05", "2023-03-05", "None"]
    # any selection of columns leaves out the same rows
    assert left.select("city").count() == 3
    with pytest.raises(ValueError, match="malformed"):
        readers.read_letters_csv(spark, str(tmp_path), malformed="ignore")
    (tmp_path / "stores.csv").write_text("STORE_ID,STORE_NAME,STORE_CHAIN_NAME,STREET_ADDRESS,ZIP_CODE\n1,One,C,1 Oak,00012\n")
    options = ["--letters", str(tmp_path), "--stores", str(tmp_path / "stores.csv"), "--out", str(tmp_path / "out")]
    main(["match", *options, "--malformed", "leave-out"])
    assert "left out or undated: 3" in (shown := capsys.readouterr().out) and "letters: 3" in shown
    assert spark.read.parquet(str(tmp_path / "out" / "warning_letters_violations")).count() == 3


def test_a_run_folder_goes_with_its_tables(spark, tmp_path):
    with run_folder(spark, str(tmp_path)) as folder:
        table = stored(spark.range(5), "numbers")
        assert table.count() == 5 and shared_dir(spark) == folder and len(os.listdir(folder)) == 1
    assert os.listdir(tmp_path) == []


ALONE = """
from pyspark.sql import SparkSession
from tillmark.sources.scratch import shared_dir, stored
spark = SparkSession.builder.master({master!r}).config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert stored(spark.range(7), "numbers").count() == 7
print("folder", shared_dir(spark))
"""


@pytest.mark.parametrize("master", ["local", "local[2]"])
def test_a_plain_local_session_needs_no_folder(tmp_path, master):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    keep = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_SUBMIT"))}
    env = keep | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    done = subprocess.run(
        [sys.executable, "-c", ALONE.format(master=master)], env=env, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    folder = done.stdout.split("folder ")[1].strip()
    assert not os.path.exists(folder)
