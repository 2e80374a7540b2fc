"""Industry-chain tags, honours and certificates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.fixed_values import (
    HONOR_SPLIT,
    LISTED_WORDS,
    NOT_REVOKED,
    POSITIONS,
    RELATEDNESS_RANK,
)
from leadlake.functions.text import any_word, clean, empty_strings, is_empty, lookup, strip


def text_list(c: Column) -> Column:
    """Array of a JSON list, of 'A | B' text or of a single value."""
    trimmed = strip(F.coalesce(c, F.lit("")))
    listed = F.from_json(F.when(trimmed.startswith("["), trimmed), "array<string>")
    items = F.coalesce(listed, F.array(trimmed))
    return unpack(items)


def unpack(items: Column) -> Column:
    """Split packed elements 'A | B', trim, and drop empty ones."""
    parts = F.flatten(
        F.transform(
            F.coalesce(items, empty_strings()),
            lambda x: F.when(x.contains(" | "), F.split(x, r"\|")).otherwise(F.array(x)),
        )
    )
    return F.filter(F.transform(parts, strip), lambda p: p.isNotNull() & (p != ""))


def distinct_values(items: Column, limit: int | None = None) -> Column:
    """Different values in order of appearance, all or the first ``limit`` for display."""
    values = F.array_distinct(items)
    return values if limit is None else F.slice(values, 1, limit)


def honors(raw: Column) -> Column:
    parts = F.transform(F.split(raw, HONOR_SPLIT), strip)
    return F.when(is_empty(raw), empty_strings()).otherwise(F.filter(parts, lambda p: p != ""))


def chain_levels(*levels: Column) -> Column:
    return F.filter(F.array(*[clean(c) for c in levels]), lambda x: x.isNotNull())


def chain_industry(levels: Column, folder: Column) -> Column:
    """First category level, else the industry named by the source folder."""
    named = F.regexp_replace(folder, "产业链企查查|企查查", "")
    return F.coalesce(F.try_element_at(levels, F.lit(1)), clean(named))


def chain_path(levels: Column, node: Column) -> Column:
    """'l1 / l2 / node'; a node equal to the last level is not repeated."""
    last = F.try_element_at(levels, F.lit(-1))
    named = F.coalesce(clean(node), last)
    extra = F.when(named.isNull() | (named == last), empty_strings()).otherwise(F.array(named))
    path = F.concat(levels, extra)
    return F.when(F.size(path) > 0, F.array_join(path, " / "))


def finance_tag(raw: Column) -> Column:
    text = strip(raw)
    return (
        F.when(raw.isNull() | (raw == ""), F.lit(None).cast("string"))
        .when(text == "未融资", "未融资")
        .when(is_empty(text), "未知")
        .when(any_word(text, LISTED_WORDS), "已上市")
        .otherwise("有融资信号")
    )


def relatedness_rank(c: Column) -> Column:
    return lookup(RELATEDNESS_RANK, c, "int")


def positions(c: Column) -> Column:
    """Which of upstream, midstream, downstream a text names."""
    return F.filter(F.array(*[F.lit(p) for p in POSITIONS]), lambda p: c.contains(p))


def is_revoked(raw: Column) -> Column:
    """Any text other than the known 'no' spellings counts as revoked."""
    return (~strip(F.coalesce(raw, F.lit(""))).isin(*NOT_REVOKED)).cast("tinyint")


def certificate_number(raw: Column, year: Column, code: Column) -> Column:
    """Number given, else 'HT-<year>-<last 8 of the code>'."""
    made = F.concat_ws("-", F.lit("HT"), F.coalesce(year, F.lit("NA")), F.substring(code, -8, 8))
    return F.coalesce(clean(raw), made)


def first_filled(*columns: Column) -> Column:
    """First cell with a value: how repeated headers of one field are folded."""
    return F.coalesce(*[clean(c) for c in columns])


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))
