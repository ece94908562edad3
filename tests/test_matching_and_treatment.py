from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillmark.operators import matching, treatment

LETTER = (
    "a string, b date, c date, d string, e string, f string, g string, h string, i string"
)
DAY = dt.date(2023, 3, 5)


def letters(spark, rows):
    """rows: (store type, address, zip)."""
    full = [(t, DAY, None, f"L{i}", a, "c", "s", z, None) for i, (t, a, z) in enumerate(rows)]
    return spark.createDataFrame(full, LETTER)


def stores(spark, rows):
    """rows: (id, address, zip)."""
    schema = "STORE_ID long, STORE_NAME string, STORE_CHAIN_NAME string, STREET_ADDRESS string, ZIP_CODE string"
    return spark.createDataFrame([(i, f"S{i}", "chain", a, z) for i, a, z in rows], schema)


def test_letter_preparation(spark):
    df = letters(spark, [(" Retail", " 1 Oak ", '"01234"'), ("Online ", "x", "1"), ("online", "x", "1"), (None, None, None)])
    got = {r.store_name: r for r in matching.prep_letters(df).collect()}
    assert set(got) == {"L0", "L3"}
    assert (got["L0"].store_type, got["L0"].address, got["L0"].zip_code) == ("Retail", "1 Oak", "01234")
    assert (got["L3"].store_type, got["L3"].zip_code, got["L3"].products) == ("nan", None, "nan")
    joined = {r.store_name: r.zip_code for r in matching.prep_letters(df, null_zip="join").collect()}
    assert joined["L3"] == "nan"
    assert got["L3"].issue_date is None
    with pytest.raises(ValueError):
        matching.prep_letters(df.drop("a"))


def test_store_preparation_and_zip_rules(spark):
    df = stores(spark, [(1, " 1 Oak ", "12345-6789"), (2, None, None)])
    rows = {r.store_id: r for r in matching.prep_stores(df).collect()}
    assert rows[1].zip_code == "12345-6789" and rows[1].address == "1 Oak"
    assert rows[2].zip_code is None and rows[2].address == "nan"
    assert rows[1].store_chain_name_pdi == "chain"
    five = {r.store_id: r.zip_code for r in matching.prep_stores(df, zip5=True).collect()}
    assert five == {1: "12345", 2: None}
    joined = {r.store_id: r.zip_code for r in matching.prep_stores(df, null_zip="join").collect()}
    assert joined[2] == "nan"
    with pytest.raises(ValueError, match="null_zip"):
        matching.prep_stores(df, null_zip="drop")


def test_zip_codes_of_another_type(spark):
    df = stores(spark, [(1, "1 Oak", "12345")]).withColumn("ZIP_CODE", F.lit(12345))
    assert [r.zip_code for r in matching.prep_stores(df).collect()] == ["12345"]


def test_candidates_join_missing_zips_and_keep_unmatched_stores(spark):
    ours = stores(spark, [(1, "1 Oak", None), (2, "2 Oak", "2"), (3, "3 Oak", "3-1")])
    theirs = letters(spark, [("r", "1 Oak St.", None), ("r", "2 oak", "2"), ("r", "9 Elm", "2")])
    s = matching.prep_stores(ours, null_zip="join")
    ls = matching.prep_letters(theirs, null_zip="join")
    got = {(r.store_id, r.store_name_fda) for r in matching.zip_candidates(s, ls).collect()}
    assert got == {(1, "L0"), (2, "L1"), (2, "L2"), (3, None)}
    apart = matching.zip_candidates(matching.prep_stores(ours), matching.prep_letters(theirs))
    got = {(r.store_id, r.store_name_fda) for r in apart.collect()}
    assert got == {(1, None), (2, "L1"), (2, "L2"), (3, None)}


def test_crowded_zips_give_the_pairs_of_a_plain_join(spark):
    # copies of rows, missing ZIPs and ZIPs that one side lacks
    ours = spark.range(60).selectExpr("nullif(cast(pmod(id, 5) as string), '4') as zip_code", "id div 2 as a")
    theirs = spark.range(90).selectExpr("nullif(cast(pmod(id * id, 7) as string), '4') as zip_code", "id div 3 as b")
    plain = sorted(map(tuple, ours.join(theirs, "zip_code").collect()))
    for pairs, lot in ((0, 1), (200, 4), (300, 7), (1 << 20, 4)):
        found = matching.by_zip(ours, theirs, None, pairs, lot)
        assert found.columns == ["zip_code", "a", "b"]
        assert sorted(map(tuple, found.collect())) == plain
    assert matching.crowded_zips(ours, theirs, 200).count() in range(1, 4)


def test_cleaning_before_the_join_equals_cleaning_after_it(spark):
    s = matching.prep_stores(stores(spark, [(i, f"{i} North Oák Street, Suite {i}", str(i % 3)) for i in range(12)]))
    ls = matching.prep_letters(letters(spark, [("r", f"{i} N. Oak St. apt", str(i % 4)) for i in range(12)]))
    from tillmark.functions.text import clean_addresses

    late = matching.score_candidates(
        clean_addresses(matching.zip_candidates(s, ls), ["address_pdi", "address_fda"])
    )
    early = matching.match_candidates(s, ls)
    assert sorted(map(str, early.collect())) == sorted(map(str, late.select(*early.columns).collect()))
    ranked = [r.similarity_score for r in matching.rank_candidates(early).collect()]
    known = [x for x in ranked if x is not None]
    assert known == sorted(known, reverse=True) and ranked[len(known) :] == [None] * (len(ranked) - len(known))
    top = matching.top_candidates(early, 3).collect()
    assert [r.similarity_score for r in top] == ranked[:3]


def test_summary_of_scores(spark):
    df = spark.createDataFrame([(10,), (20,), (40,), (None,)], "similarity_score int")
    r = matching.score_summary(df).first()
    assert (r["count"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]) == (3, 10, 15, 20, 30, 40)
    assert r["mean"] == pytest.approx(70 / 3) and r["std"] == pytest.approx(15.2752523)


def test_treatment_months_fan_out_and_flags(spark):
    panel = spark.createDataFrame(
        [(1, dt.date(2023, 3, 1), 1.0), (1, dt.date(2023, 4, 1), 1.0), (2, dt.date(2023, 3, 1), 1.0)],
        "store_id long, date date, level double",
    )
    march, may, june = dt.date(2023, 3, 9), dt.date(2023, 5, 2), dt.date(2023, 6, 2)
    reviewed = spark.createDataFrame(
        [(1, march, may, 1), (1, march, may, 1), (1, march, june, 1), (1, march, june, 0), (2, march, None, 1)],
        "store_id long, insp_date date, issue_date date, matching int",
    )
    treated = treatment.assign_treatment(panel, treatment.confirmed_matches(reviewed))
    got = sorted((r.store_id, r.date.month, r.insp, r.issue, str(r.issue_date)) for r in treated.collect())
    assert got == [
        (1, 3, 1, 1, "2023-05-01"), (1, 3, 1, 1, "2023-06-01"), (1, 4, 0, 0, "None"), (2, 3, 1, 0, "None"),
    ]
    assert treatment.treatment_counts(treated).first().asDict() == {
        "rows": 4, "store_months": 3, "insp_rows": 3, "issue_rows": 2,
    }
    empty = treatment.assign_treatment(panel.filter(F.lit(False)), reviewed)
    assert treatment.treatment_counts(empty).first().asDict()["rows"] == 0
