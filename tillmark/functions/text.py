"""Address text as native column expressions (no Python worker in the plan)."""

from __future__ import annotations

import string
import sys
import unicodedata
from collections.abc import Sequence
from functools import cache, reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

# Whitespace as Python's str.strip() and \s see it (fixed values).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ASCII_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
WORD_OR_COMMA = string.ascii_letters + string.digits + "_,"
NON_ASCII = r"[^\x00-\x7f]"

# Street-word rules, applied in this order, case-insensitively.
# The dot in "St." and the like is any character; that is part of the rule.
STREET_RULES: tuple[tuple[str, str], ...] = (
    (r"\bStreet\b", "St"),
    (r"\bSt.\b", "St"),
    (r"\bAvenue\b", "Ave"),
    (r"\bAve.\b", "Ave"),
    (r"\bBoulevard\b", "Blvd"),
    (r"\bBlvd.\b", "Blvd"),
    (r"\bRoad\b", "Rd"),
    (r"\bRd.\b", "Rd"),
    (r"\bDrive\b", "Dr"),
    (r"\bDr.\b", "Dr"),
    (r"\bLn\b", "Lane"),
    (r"\bLn.\b", "Lane"),
    (r"\bPl\b", "Place"),
    (r"\bPl.\b", "Place"),
    (r"\bCt\b", "Court"),
    (r"\bCt.\b", "Court"),
    (r"\bHighway\b", "Hwy"),
    (r"\bsuite\b.*", ""),
    (r"\bSuite\b.*", ""),
    (r"\bste\b.*", ""),
    (r"\bSTE\b.*", ""),
    (r"\,", ""),
    (r"\bNortheast\b", "NE"),
    (r"\bNorthwest\b", "NW"),
    (r"\bSoutheast\b", "SE"),
    (r"\bSouthwest\b", "SW"),
    (r"\bNorth east\b", "NE"),
    (r"\bNorth west\b", "NW"),
    (r"\bSouth east\b", "SE"),
    (r"\bSouth west\b", "SW"),
    (r"\bNorth\b", "N"),
    (r"\bSouth\b", "S"),
    (r"\bEast\b", "E"),
    (r"\bWest\b", "W"),
    (r"\bN(?:\.)?\b", "N"),
    (r"\bS(?:\.)?\b", "S"),
    (r"\bE(?:\.)?\b", "E"),
    (r"\bW(?:\.)?\b", "W"),
    (r"\bNE(?:\.)?\b", "NE"),
    (r"\bNW(?:\.)?\b", "NW"),
    (r"\bSE(?:\.)?\b", "SE"),
    (r"\bSW(?:\.)?\b", "SW"),
    (r"\bN E(?:\.)?\b", "NE"),
    (r"\bN W(?:\.)?\b", "NW"),
    (r"\bS E(?:\.)?\b", "SE"),
    (r"\bS W(?:\.)?\b", "SW"),
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def as_text(c: Column, null_token: str | None = "nan") -> Column:
    """Text with missing values spelled out as ``null_token`` (None keeps NULL)."""
    text = c.cast("string")
    return text if null_token is None else F.coalesce(text, F.lit(null_token))


class FoldTable(NamedTuple):
    """ASCII part of code points whose NFKD form has one.

    ``source`` and ``target`` align the code points with one ASCII character.
    ``several`` is a character class of those with more than one, and
    ``expansions`` lists them as lines of "character TAB replacement".
    """

    source: str
    target: str
    several: str
    expansions: str


@cache
def fold_table() -> FoldTable:
    """Built from the Unicode database rather than listed.

    Decomposition works character by character and its reordering step only
    moves combining marks, which are dropped anyway: a table per character is
    exact.
    """
    ascii_part = {}
    for point in range(0x80, sys.maxunicode + 1):
        form = unicodedata.normalize("NFKD", chr(point))
        if form != chr(point):
            ascii_part[chr(point)] = form.encode("ascii", "ignore").decode("ascii")
    single = {c: a for c, a in ascii_part.items() if len(a) == 1}
    several = {c: a for c, a in ascii_part.items() if len(a) > 1}
    return FoldTable(
        "".join(single),
        "".join(single.values()),
        f"[{''.join(several)}]",
        "\n".join(f"{c}\t{a}" for c, a in several.items()),
    )


def ascii_fold(c: Column) -> Column:
    """NFKD-decompose and drop what is not ASCII.

    ASCII text passes through untouched.  The walk over single characters runs
    only for text with a character that expands to several.
    """
    table = fold_table()
    folded = F.translate(c, table.source, table.target)
    expansions = F.str_to_map(F.lit(table.expansions), F.lit("\n"), F.lit("\t"))

    def expand(char: Column) -> Column:
        return F.when(char.rlike(NON_ASCII), F.coalesce(expansions[char], char)).otherwise(char)

    expanded = F.array_join(F.transform(F.split(folded, ""), expand), "")
    # the wide character class is only tried on what is left beside ASCII
    left_over = F.regexp_replace(folded, r"[\x00-\x7f]+", "")
    mapped = F.when(left_over.rlike(table.several), expanded).otherwise(folded)
    return F.when(c.rlike(NON_ASCII), F.regexp_replace(mapped, NON_ASCII, "")).otherwise(c)


def _any_of(chars: str) -> str:
    """Character class that lists ASCII characters one by one.

    The regex engine turns such a list into a bitmap, several times faster on
    long texts than ranges or a negated class.
    """
    return "[" + "".join(f"\\x{ord(ch):02x}" for ch in chars) + "]+"


def basic_clean(c: Column) -> Column:
    """ASCII fold, drop punctuation except commas, collapse whitespace, strip."""
    kept = WORD_OR_COMMA + ASCII_SPACE
    dropped = "".join(ch for ch in map(chr, range(128)) if ch not in kept)
    words = F.regexp_replace(ascii_fold(c), _any_of(dropped), "")
    return F.trim(F.regexp_replace(words, _any_of(ASCII_SPACE), " "))


def expand_street_words(c: Column) -> Column:
    """The street-word rules in order; the result is not trimmed again."""
    return reduce(
        lambda text, rule: F.regexp_replace(text, f"(?id){rule[0]}", rule[1]), STREET_RULES, c
    )


def normalise_address(c: Column) -> Column:
    return expand_street_words(basic_clean(c))


def clean_addresses(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({name: normalise_address(F.col(name)) for name in columns})
