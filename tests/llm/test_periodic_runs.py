"""Runs against a brute-force search, and the collapsed texts."""

import random
import re

import numpy as np
import pytest

from tests.llm.tables import documents, prose
from tillmark.llm.periodic_runs import MIN_EXPONENT, MIN_LENGTH, SuffixTree, collapse_runs, runs_of

WORDS = r"[^\x20\x09-\x0D]+"


def brute_runs(words, min_length=MIN_LENGTH, min_exponent=MIN_EXPONENT):
    found = []
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    smallest = [
        (i, n, q) for i, n, q in found if not any(a <= i and i + n <= a + m and p < q for a, m, p in found)
    ]
    return sorted(smallest, key=lambda r: (r[0], r[2]))


def brute_collapsed(text):
    words = re.findall(WORDS, text or "")
    runs = brute_runs(words)
    lost = {i for start, length, q in runs for i in range(start + q, start + length)}
    return len(words), runs, " ".join(w for i, w in enumerate(words) if i not in lost)


def test_runs_of_random_words_equal_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        n, kinds = rng.randint(0, 60), rng.choice([1, 2, 3, 5])
        word = [rng.randint(1, kinds) for _ in range(n)]
        if n > 3 and rng.random() < 0.7:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            word = [word[i] if i < a else word[a + (i - a) % p] for i in range(n)]
        least, times = rng.choice([2, 3, 6, 24]), rng.choice([2, 3])
        got = [tuple(r) for r in runs_of(np.array(word, dtype=np.int64), least, times).tolist()]
        assert got == brute_runs(word, least, times)


def test_suffix_tree_orders_all_suffixes():
    rng = random.Random(6)
    for kinds in (1, 2, 4):
        text = [rng.randint(1, kinds) for _ in range(80)] + [0]
        tree = SuffixTree(text, kinds + 1)
        assert len(tree.span) <= 2 * len(text)
        for descending in (False, True):
            ranked = [(-x if descending and x else x) for x in text]
            lowest = [min(ranked) - 1 if x == 0 else x for x in ranked]
            order = sorted(range(len(text)), key=lambda i: lowest[i:])
            assert np.argsort(tree.suffix_ranks(descending)).tolist() == order


@pytest.fixture(scope="module")
def periodic():
    phrase, long = prose(31, 9), prose(32, 700)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, prose(33, 400)),
        (6, " ".join([phrase] * 4)), (7, "  " + "\t".join([phrase] * 4) + "\n"), (7, " ".join([phrase] * 4)),
        (8, "so " * 23), (9, "so " * 24), (None, "so " * 40), (10, "a b " * 12 + "a"), (11, "a b " * 12 + "b a"),
        (12, prose(34, 50) + " " + " ".join([phrase] * 3) + " end"), (13, " ".join([long] * 3)),
        (14, " ".join([long] * 2)), (15, "x y " * 30 + "z " * 30 + "x y " * 30), (16, "é ß " * 20),
        (17, " ".join(["a a b"] * 10 + ["c"] + ["a a b"] * 10)), (18, "Word word " * 15),
        (19, prose(35, 20_000) + (" " + prose(36, 11)) * 4),
    ]


def test_collapsed_texts_equal_brute_force(spark, periodic):
    found = collapse_runs(documents(spark, periodic).repartition(3)).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found)
    want = sorted((str(i), *brute_collapsed(text)) for i, text in periodic if i != 19)
    assert [r for r in got if r[0] != "19"] == want
    # too long for the brute force: one planted phrase of 11 words, four times
    (last,) = [r for r in got if r[0] == "19"]
    assert last[1] == 20_044 and [(n, q) for _, n, q in last[2]] == [(44, 11)]


def test_collapsing_nothing_gives_nothing(spark):
    empty = collapse_runs(documents(spark, []))
    assert empty.columns == ["doc_id", "n_words", "runs", "collapsed"] and empty.isEmpty()


def test_collapsing_takes_text_ids(spark):
    docs = spark.createDataFrame([("d1", "so " * 30), (None, None)], "doc_id string, text string")
    rows = {r["doc_id"]: r["collapsed"] for r in collapse_runs(docs).collect()}
    assert rows == {"d1": "so", None: ""}
