"""Spelling variants against all pairs of words."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.tables import documents
from tillmark.llm.spelling import (
    Cells,
    PointTree,
    frequent_words,
    letter_counts,
    letter_runs,
    letters_of,
    one_inserted,
    spelling_variants,
)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    forms, near = {}, {}
    for word, n in counts.items():
        others = [(-m, o) for o, m in counts.items() if one_edit(word, o)]
        near[word] = len(others)
        best = min(others, default=None)
        forms[word] = best[1] if best and -best[0] >= 2 * n else None
    rows = []
    for word, n in counts.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        form = forms[word]
        rows.append((word, n, near[word], form, counts.get(form), root))
    return sorted(rows)


def some_words(seed, count, letters="abcé", sizes=(5, 6, 7)):
    rng = random.Random(seed)
    words = {}
    while len(words) < count:
        words["".join(rng.choice(letters) for _ in range(rng.choice(sizes)))] = rng.choice([3, 3, 4, 7, 9, 20, 50])
    return words


def found(spark, words, **options):
    given = spark.createDataFrame([(w, n, "clash") for w, n in words.items()], "word string, n long, best string")
    result = spelling_variants(given.repartition(3), **options)
    assert result.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted(tuple(r) for r in result.collect())


@pytest.mark.parametrize("options", [{}, {"cell": 20}, {"cell": 8, "sample": 60}])
def test_variants_equal_all_pairs(spark, options):
    words = some_words(1, 400) | {"naïveté": 9, "naiveté": 4, "aaaaa": 1000, "aaaaaa": 10, "a" * 3000: 9, "a" * 3001: 4}
    assert found(spark, words, **options) == brute_variants(words)


def test_words_of_one_letter_set_are_dealt_by_hash(spark):
    # permutations share one point, so no cut can part them
    rng = random.Random(2)
    words = {"".join(rng.sample("abcdefg", 7)): 3 for _ in range(150)} | {"xbcdefg": 9}
    assert found(spark, words, cell=16) == brute_variants(words)


def test_forms_are_followed_to_the_last(spark):
    words = {"stone": 3, "stones": 6, "stonez": 12, "stoney": 12, "xstoney": 24, "alone": 3}
    rows = {r[0]: r for r in found(spark, words)}
    assert rows["stone"][3:] == ("stoney", 12, "xstoney") and rows["alone"][2:] == (0, None, None, "alone")
    assert rows["xstoney"][3:] == (None, None, "xstoney")


def test_no_words(spark):
    nothing = spark.createDataFrame([(None, 4), ("", 4)], "word string, n long")
    assert spelling_variants(nothing).isEmpty()


def test_runs_and_counts(spark):
    rows = [(1, None), (2, ""), (3, "Stone-STONE stone2stone ÉTÉÉÉ étééé"), (None, "stone"), (3, "Abcde abcde"), (4, "123 \n")]
    runs = letter_runs(documents(spark, rows))
    assert sorted(r["word"] for r in runs.collect()) == sorted(["stone"] * 5 + ["ÉtÉÉÉ", "étééé"] + ["abcde"] * 2)
    assert [tuple(r) for r in frequent_words(runs).collect()] == [("stone", 5, 5)]


def test_tree_search_and_cells_miss_nothing():
    words = sorted(some_words(3, 600, letters="abcdefgh", sizes=(6,)))
    counts = letter_counts(letters_of(pa.array(words), 6))
    distance = np.abs(counts[:, None, :].astype(int) - counts[None].astype(int)).sum(axis=2)
    for radius in (1, 2):
        pairs = {(a, b) for i, j in PointTree(counts, leaf=4).search(counts, radius) for a, b in zip(i.tolist(), j.tolist())}
        assert pairs == set(zip(*(x.tolist() for x in np.nonzero(distance <= radius))))
        cells = Cells.fit(counts[::3], 1 / 3, 30)
        home = cells.home(counts, np.arange(len(counts)))
        reached = {(r, cell) for cell, rows in cells.near(counts, radius) for r in rows.tolist()}
        assert len(set(home.tolist())) > 5
        assert all((a, home[b]) in reached for a, b in pairs)


def test_one_inserted():
    short, long = (letters_of(pa.array(w), len(w[0])) for w in (["abca", "abca", "aaaa", "abca"], ["abcaa", "xabca", "aaaaa", "abxcb"]))
    assert one_inserted(short, long).tolist() == [True, True, True, False]
