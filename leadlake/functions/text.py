"""Cleaning of text columns: empties, byte limits, multi-value cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.fixed_values import EMPTY_TOKENS, MULTI_SPLIT, WHITE_SPACE

EMPTY_ARRAY = "array<string>"


def empty_strings() -> Column:
    return F.array().cast(EMPTY_ARRAY)


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.trim(c, F.lit(WHITE_SPACE))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def is_empty(c: Column, tokens=EMPTY_TOKENS) -> Column:
    """True for NULL, blank and sentinel text; never NULL itself."""
    return F.coalesce(F.array_contains(word_array(tokens), F.lower(strip(c))), F.lit(True))


def clean(c: Column, tokens=EMPTY_TOKENS) -> Column:
    """Trimmed text, or NULL where the text only says that there is no value."""
    s = strip(c)
    return F.when(~F.array_contains(word_array(tokens), F.lower(s)), s)


def blank(c: Column) -> Column:
    """NULL or '' (the two forms in which a target column can be unfilled)."""
    return c.isNull() | (c.cast("string") == "")


def byte_truncate(c: Column, limit: int) -> Column:
    """Cut to at most ``limit`` UTF-8 bytes without splitting a character."""
    head = F.substring(F.encode(c, "UTF-8"), 1, limit).cast("string")
    cut = F.regexp_replace(F.make_valid_utf8(head), "\\x{FFFD}+$", "")
    return F.when(F.octet_length(c) <= limit, c).otherwise(cut)


def split_multi(c: Column, pattern: str = MULTI_SPLIT, tokens=EMPTY_TOKENS) -> Column:
    """Parts of a multi-value cell, without empty ones; [] for an empty cell."""
    parts = F.filter(F.split(strip(c), pattern), lambda p: ~is_empty(p, tokens))
    return F.when(is_empty(c, tokens), empty_strings()).otherwise(parts)


def any_word(c: Column, words) -> Column:
    """True where the text contains one of the words (which are plain text)."""
    return c.rlike("|".join(f"\\Q{w}\\E" for w in words))


def filled_count(columns) -> Column:
    """How many of the columns carry a value: the completeness score of a row."""
    total = F.lit(0)
    for c in columns:
        total = total + (~is_empty(c)).cast("int")
    return total


def word_array(words) -> Column:
    """A fixed list as one literal, which the optimizer folds into an array."""
    return F.split(F.lit("\x1f".join(words)), "\x1f")


def lookup(mapping: dict, key: Column, value_type: str = "string") -> Column:
    """Value of a small fixed map, NULL for an unknown key."""
    entries = "\x1e".join(f"{k}\x1f{v}" for k, v in mapping.items())
    table = F.str_to_map(F.lit(entries), F.lit("\x1e"), F.lit("\x1f"))
    return F.try_element_at(table, key).cast(value_type)


def bucket_label(n: Column, edges) -> Column:
    """'lo-hi' label of the histogram bucket of n, '>=lo' for the last one."""
    label = F.lit("0")
    for i, low in enumerate(edges):
        text = f">={low}" if i + 1 == len(edges) else f"{low}-{edges[i + 1] - 1}"
        label = F.when(n >= low, F.lit(text)).otherwise(label)
    return label
