"""Ranked lists, bounds on scores, and pairs dealt out by their words."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.test_matching_and_treatment import letters, stores
from tests.test_plans import settings
from tillmark.functions.similarity import letter_tags, ratio_bound, sorted_ratio
from tillmark.operators import matching
from tillmark.operators.matching import ScoreCounts


def scored(spark, rows):
    """rows: (score, address)."""
    full = [(a, "b", i, s) for i, (s, a) in enumerate(rows)]
    return spark.createDataFrame(full, "address_pdi string, address_fda string, store_id long, similarity_score int")


def counted(df):
    return ScoreCounts.of(df.agg(*[c.alias(n) for n, c in matching.score_counts().items()]).first().asDict())


def crowd(seed, rows):
    rng = random.Random(seed)
    scores = [None] * 4 + [30] * 8 + [0, 7, 55, 90, 100]
    words = ["", "Ä", "a", "zebra", "1 Oak", "12 Oak", "é"]
    return [
        (rng.choice(scores), None if rng.random() < 0.05 else f"{rng.choice(words)} {rng.randrange(40)}")
        for _ in range(rows)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_ranking_by_counts_equals_a_sort(spark, seed):
    rows = scored(spark, crowd(seed, 900)).repartition(5)
    with settings(spark, spark__sql__shuffle__partitions="12"):
        ranked = matching.rank_candidates(rows, counted(rows))
        parts = ranked.select("*", F.spark_partition_id().alias("part")).collect()
        plain = [tuple(r) for r in matching.rank_candidates(rows).collect()]
    assert [tuple(r)[:-1] for r in parts] == plain
    sizes = [sum(r["part"] == p for r in parts) for p in {r["part"] for r in parts}]
    # crowded scores are spread over several partitions
    assert len(sizes) > 8 and max(sizes) < 900 / 4


def test_ranking_computes_each_score_once(spark):
    rows = scored(spark, crowd(3, 200))
    counts, seen = counted(rows), spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    with settings(spark, spark__sql__shuffle__partitions="2"):
        assert matching.rank_candidates(rows.mapInArrow(run, rows.schema), counts).count() == 200
    # no sampling; a score with over half of the rows would be read again for its cuts
    assert seen.value == 200


def test_ranking_nothing(spark):
    rows = scored(spark, [])
    assert matching.rank_candidates(rows, counted(rows)).collect() == []


@pytest.mark.parametrize("rows", [[], [(None, "a")], [(5, "a")], crowd(4, 100), crowd(5, 101)])
def test_counts_summarise_as_an_aggregation_does(spark, rows):
    df = scored(spark, rows)
    counts = counted(df)
    expected = matching.score_summary(df).first().asDict()
    assert counts.summary() == {k: v if v is None else pytest.approx(v) for k, v in expected.items()}
    known = sorted((s for s, _ in rows if s is not None), reverse=True)
    assert counts.rows == len(rows) and [counts.nth(i + 1) for i in range(len(known))] == known


def test_no_score_exceeds_its_bound(spark):
    rng = random.Random(6)
    words = ["oak", "elm", "12", "aab", "st", "é", "😀", ""]

    def text():
        return None if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.randrange(5)))

    df = spark.createDataFrame([(text(), text()) for _ in range(400)], "a string, b string")
    a, b = F.col("a"), F.col("b")
    found = df.select(sorted_ratio(a, b).alias("s"), ratio_bound(a, b, letter_tags(a), letter_tags(b)).alias("bound")).collect()
    assert all((r.s is None) == (r.bound is None) and (r.s is None or r.s <= r.bound <= 100) for r in found)
    assert sum(r.s is not None and r.bound < 60 for r in found) > 50


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(7)
    streets = ["Oak", "Elm", "Maple", "Sunset", "River", "Lake", "Hill", "Park"]

    def address(i):
        return f"{rng.randrange(30)} {rng.choice(streets)} {rng.choice(streets)} St"

    s = stores(spark, [(i, address(i), f"{i % 5}") for i in range(60)])
    ls = letters(spark, [("r", address(i), f"{i % 6}") for i in range(80)])
    return matching.prep_stores(s), matching.prep_letters(ls)


@pytest.mark.parametrize("n", [1, 10, 60])
def test_the_top_list_scores_few_pairs(spark, sides, n):
    everything = matching.match_candidates(*sides)
    best = [tuple(r) for r in matching.top_candidates(everything, n).collect()]
    assert [tuple(r) for r in matching.top_matches(*sides, n).collect()] == best
    pairs = matching.bounded_pairs(*sides)
    least = matching.least_useful_bound(pairs, n)
    assert least <= best[-1][-1]
    useful, known = pairs.where(F.col("__bound") >= least).count(), pairs.count()
    assert n <= useful <= known and (n > 10 or useful < known / 2)


def test_the_top_list_with_ties_and_few_pairs(spark):
    s = matching.prep_stores(stores(spark, [(i, "1 Oak", "1") for i in range(30)] + [(90, "9 Elm", "2")]))
    ls = matching.prep_letters(letters(spark, [("r", "1 Oak", "1"), ("r", "1 Oka", "1"), ("r", "77 Pine", "1")]))
    everything = matching.match_candidates(s, ls)
    for n in (5, 30, 31, 95):
        best = [tuple(r) for r in matching.top_candidates(everything, n).collect()]
        assert [tuple(r) for r in matching.top_matches(s, ls, n).collect()] == best
    with pytest.raises(ValueError):
        matching.top_matches(s, ls, 0)


def test_equal_pairs_of_words_meet_in_one_task(spark):
    names = [(f"w{i % 40}", f"v{i % 5}") for i in range(4000)]
    pairs = spark.createDataFrame(names, "a string, b string").repartition(7)
    apart = {"spark__sql__adaptive__coalescePartitions__enabled": "false"}
    with settings(spark, spark__sql__shuffle__partitions="6", **apart):
        dealt = matching.dealt_by_words(pairs, "a", "b").select("*", F.spark_partition_id().alias("part")).collect()
    searched = {(r.part, r.a, r.b) for r in dealt}
    assert len(dealt) == 4000 and len({r.part for r in dealt}) > 1
    # one search a pair, but for pairs whose task was too large
    assert len(searched) <= 2 * len(set(names))
    for before, after in zip(dealt, dealt[1:]):
        assert before.part != after.part or (before.b, before.a) <= (after.b, after.a)
