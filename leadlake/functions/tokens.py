"""Keyword tokens: single Han characters, Han bigrams, and lower-case words of any other script.

The store behind the published queries does not specify its tokeniser; this
one is documented here and the search operators are defined by it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.fixed_values import HAN

#: Letters and digits of all scripts but Han, which is cut into characters.
WORD = r"(?:[^\P{L}\x{4e00}-\x{9fff}]|\p{N})+"
HAN_RUN = rf"{HAN}+"


def _grams(run: Column) -> Column:
    singles = F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substring(run, i, 1))
    pairs = F.transform(
        F.filter(F.sequence(F.lit(1), F.length(run)), lambda i: i < F.length(run)),
        lambda i: F.substring(run, i, 2),
    )
    return F.concat(singles, pairs)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def tokens(c: Column) -> Column:
    """Distinct tokens of a text; [] for NULL."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(HAN_RUN), F.lit(0))
    return F.array_distinct(F.concat(words(c), F.flatten(F.transform(runs, _grams))))


def matches_all(c: Column, query: str) -> Column:
    """Every token of the query occurs in the text."""
    return F.size(F.array_except(tokens(F.lit(query)), tokens(c))) == 0


def matches_any(c: Column, query: str) -> Column:
    """At least one token of the query occurs in the text."""
    return F.arrays_overlap(tokens(F.lit(query)), tokens(c))
