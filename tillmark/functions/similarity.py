"""Token-sort similarity of two texts, 0 to 100.

The score is the Ratcliff-Obershelp ratio (2 x matched characters / total) of
the two texts after their words are lower-cased and sorted.  Normalisation and
every trivial case are native; Arrow batches carry only the pairs that need the
matching-block search, which SQL expressions cannot state.
"""

from __future__ import annotations

import sys
from difflib import SequenceMatcher
from operator import itemgetter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from tillmark.functions.text import strip


def token_sorted(c: Column) -> Column:
    """Lower-cased words (letters, digits, underscore) in code-point order."""
    text = F.regexp_replace(strip(F.lower(c)), r"[\u0080-\u00ff]", "")
    words = F.split(F.trim(F.lower(F.regexp_replace(text, r"(?U)\W+", " "))), " ")
    return F.array_join(F.array_sort(words), " ")


def block_ratios(a: pa.Array, b: pa.Array) -> pa.Array:
    """Scores of aligned pairs; a pair repeated in the batch is matched once.

    Pairs are visited by their second text, whose character index the matcher
    then reuses.  Texts of every length follow one rule: no frequent character is
    left out of the search.
    """
    pairs = list(zip(a.to_pylist(), b.to_pylist()))
    scores: dict[tuple[str | None, str | None], int | None] = dict.fromkeys(pairs)
    matcher = SequenceMatcher(None, autojunk=False)
    indexed = None
    for left, right in sorted((p for p in scores if None not in p), key=itemgetter(1)):
        if right != indexed:
            matcher.set_seq2(right)
            indexed = right
        matcher.set_seq1(left)
        scores[left, right] = int(round(100 * matcher.ratio()))
    return pa.array([scores[p] for p in pairs], pa.int32())


# Executors get the function itself, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
_block_ratios = F.arrow_udf(block_ratios, T.IntegerType())


def sorted_ratio(a: Column, b: Column) -> Column:
    """Score of two texts that are already :func:`token_sorted`."""
    trivial = a.isNull() | b.isNull() | (a == b) | (a == "") | (b == "")
    searched = _block_ratios(F.when(~trivial, a), F.when(~trivial, b))
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("int"))
        .when(a == b, 100)
        .when((a == "") | (b == ""), 0)
        .otherwise(searched)
    )


def letter_tags(words: Column) -> Column:
    """Every letter with its number among equal ones, so that a set holds repeated letters."""
    letters = F.array_sort(F.split(words, ""))
    return F.transform(letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c)).cast("string")))


def ratio_bound(a: Column, b: Column, tags_a: Column, tags_b: Column) -> Column:
    """No :func:`sorted_ratio` exceeds it: matched blocks share their letters, in any order."""
    total = F.length(a) + F.length(b)
    shared = F.size(F.array_intersect(tags_a, tags_b))
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("int"))
        .when(a == b, 100)
        .when((a == "") | (b == ""), 0)
        .otherwise(F.least(F.lit(100), F.ceil(F.lit(200) * shared / total).cast("int")))
    )


def similarity_score(a: Column, b: Column) -> Column:
    """0..100, NULL when either text is missing."""
    return sorted_ratio(token_sorted(a), token_sorted(b))
