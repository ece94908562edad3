"""Address text and similarity against Python's own string tools."""

from __future__ import annotations

import random
import re
import unicodedata
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.sql_views import STREET_WORDS
from tillmark.functions import text
from tillmark.functions.similarity import block_ratios, similarity_score, token_sorted
from tillmark.operators.matching import score_candidates


def python_fold(s):
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")


def python_clean(s):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s,]", "", python_fold(s))).strip()


def python_expand(s):
    for pattern, word in STREET_WORDS:
        s = re.sub(pattern, word, s, flags=re.IGNORECASE)
    return s


def python_score(a, b):
    def words(s):
        return " ".join(sorted(re.sub(r"\W", " ", s.lower()).split()))

    a, b = words(a), words(b)
    if a == b:
        return 100
    return int(round(100 * SequenceMatcher(None, a, b, False).ratio())) if a and b else 0


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, t string")


def test_fold_every_decomposable_character_and_random_text(spark):
    rng = random.Random(1)
    points = [p for p in range(1, 0x110000) if not 0xD800 <= p < 0xE000]
    mapped = [p for p in points if p > 127 and unicodedata.normalize("NFKD", chr(p)) != chr(p)]
    values = [chr(p) for p in mapped]
    for _ in range(2000):
        pools = rng.choices([points, mapped, range(1, 128)], [1, 3, 6], k=rng.randrange(30))
        values.append("".join(chr(rng.choice(p)) for p in pools))
    df = texts(spark, values).select(
        "t", text.ascii_fold(F.col("t")).alias("fold"), text.basic_clean(F.col("t")).alias("clean")
    )
    for row in df.collect():
        assert row.fold == python_fold(row.t)
        assert row.clean == python_clean(row.t)


def test_strip_removes_what_python_strips(spark):
    values = ["\x1c a 　", "\xa0x y\x85", "", "​z"]
    got = texts(spark, values).select("t", text.strip(F.col("t")).alias("s")).collect()
    assert all(r.s == r.t.strip() for r in got)


def test_known_addresses(spark):
    cases = {
        "12 Main Street Apt 4": "12 Main StApt 4",
        "12 Main Ste 4": "12 Main St 4",
        "12 Main St, Suite 5": "12 Main St ",
        "12 Elm Avenue Suite 3": "12 Elm AveSuite 3",
    }
    got = texts(spark, list(cases)).select("t", text.normalise_address(F.col("t")).alias("n"))
    assert {r.t: r.n for r in got.collect()} == cases
    accents = texts(spark, ["Étion ﬁ ß 12½", None]).select(text.ascii_fold(F.col("t")).alias("f"))
    assert [r.f for r in accents.collect()] == ["Etion fi  1212", None]


def test_street_rules_on_random_addresses(spark):
    rng = random.Random(2)
    pieces = (
        "Street St St. Avenue Ave Ave. Boulevard Blvd. Road Rd. Drive Dr Dr. Ln Ln. Pl Pl. Ct Ct. Highway"
        " suite Suite ste STE , Northeast North east South west N S. E W. NE N E S W SE. 12 Oak x_y -"
    ).split(" ")
    values = [
        rng.choice([" ", "  ", ""]).join(rng.choices(pieces, k=rng.randrange(1, 9)))
        for _ in range(1500)
    ]
    got = texts(spark, values).select("t", text.expand_street_words(F.col("t")).alias("e"))
    assert [r for r in got.collect() if r.e != python_expand(r.t)] == []


def test_known_scores(spark):
    cases = [
        ("12 main st", "main st 12", 100), ("12 main st", "120 main st", 95),
        ("1 n oak lane", "1 oak lane", 91), ("12 elm ave", "99 pine rd", 30),
        ("", "", 100), ("", "a", 0), ("...", "a", 0), (None, "a", None), ("a", None, None),
        ("A-B", "b a", 100),
    ]
    df = spark.createDataFrame(cases, "address_pdi string, address_fda string, wanted int")
    for r in score_candidates(df).collect():
        assert r.similarity_score == r.wanted, r


def test_scores_of_random_texts_including_long_ones(spark):
    rng = random.Random(3)
    words = ["oak", "main", "st", "12", "120", "n", "elm", "ave", "pine_1", "a", "7b"]
    pairs = []
    for length in [6] * 300 + [90] * 40:  # above 200 characters the matcher drops common ones
        a = rng.choices(words, k=rng.randrange(1, length))
        b = [w if rng.random() < 0.7 else rng.choice(words) for w in a]
        rng.shuffle(b)
        pairs.append((" ".join(a), "  ".join(b).upper()))
    df = spark.createDataFrame(pairs, "a string, b string").repartition(3)
    df = df.select("a", "b", similarity_score(F.col("a"), F.col("b")).alias("s"))
    assert [r for r in df.collect() if r.s != python_score(r.a, r.b)] == []


def test_block_ratios_matches_repeated_pairs_once():
    a = pa.array(["abc", "abc", None, "xyz"])
    b = pa.array(["abd", "abd", None, "abd"])
    assert block_ratios(a, b).to_pylist() == [67, 67, None, 0]


@pytest.mark.parametrize("value", ["Éa b", "ab中c d", "É\xa0x"])
def test_token_sort_drops_latin1_letters_and_keeps_other_words(spark, value):
    kept = value.lower().strip().translate({p: None for p in range(128, 256)})
    wanted = " ".join(sorted(re.sub(r"\W", " ", kept).lower().split()))
    got = texts(spark, [value]).select(token_sorted(F.col("t")).alias("w")).first().w
    assert got == wanted
