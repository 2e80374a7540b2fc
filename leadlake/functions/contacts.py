"""Phones, e-mails and mailing addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.fixed_values import (
    EMAIL,
    EMAIL_ANYWHERE,
    MAIL_ADDRESS_SPLIT,
    MOBILE,
    PHONE_DIGITS,
    SCORING_EMPTY_TOKENS,
    SCORING_SPLIT,
)
from leadlake.functions.text import is_empty, split_multi, strip


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\P{Nd}", "")


def is_mobile(c: Column) -> Column:
    return c.rlike(MOBILE)


def is_email(c: Column) -> Column:
    return c.rlike(EMAIL)


def landline(c: Column) -> Column:
    """The number as written if it has 7 to 13 digits and is not a mobile."""
    n = digits(c)
    ok = F.length(n).between(7, 13) & ~is_mobile(n)
    return F.when(ok, strip(c))


def _mobiles_in(raw: Column) -> Column:
    return F.filter(F.transform(split_multi(raw), digits), is_mobile)


def mobiles(mobile_raw: Column, landline_raw: Column) -> Column:
    """Distinct mobiles in order; those found in the landline cell follow."""
    return F.array_distinct(F.concat(_mobiles_in(mobile_raw), _mobiles_in(landline_raw)))


def landlines(raw: Column) -> Column:
    numbers = F.transform(split_multi(raw), landline)
    return F.array_distinct(F.filter(numbers, lambda v: v.isNotNull()))


def email(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "^[.,;]+|[.,;]+$", "")


def emails(*raws: Column, longest: int | None = None) -> Column:
    """Distinct addresses in order, each whole; with ``longest``, without those of more characters."""
    parts = F.transform(F.concat(*[split_multi(r) for r in raws]), email)
    short = lambda e: F.lit(True) if longest is None else F.length(e) <= longest
    return F.array_distinct(F.filter(parts, lambda e: is_email(e) & short(e)))


def mail_addresses(raw: Column) -> Column:
    """Several mailing addresses in one cell, distinct, joined by ' | '."""
    parts = F.transform(F.split(raw, MAIL_ADDRESS_SPLIT), strip)
    kept = F.array_distinct(F.filter(parts, lambda p: ~is_empty(p)))
    return F.when(~is_empty(raw) & (F.size(kept) > 0), F.array_join(kept, " | "))


def search_phone(c: Column) -> Column:
    """A phone number as typed into a search box, without prefix and separators."""
    s = F.regexp_replace(c, r"[\s\p{Z}\-()+（）]", "")
    international = s.startswith("0086") | (s.startswith("86") & (F.length(s) >= 13))
    return F.when(international, F.regexp_replace(s, "^(?:0086|86)", "")).otherwise(s)


def is_search_phone(c: Column) -> Column:
    return c.rlike(MOBILE) | c.rlike(PHONE_DIGITS)


def _scoring_phone(part: Column) -> Column:
    n = digits(F.replace(F.replace(part, F.lit("+86"), F.lit("")), F.lit("0086"), F.lit("")))
    n = F.when(F.length(n) >= 13, F.regexp_replace(n, "^86", "")).otherwise(n)
    return F.when(F.length(n).between(10, 12), n)


def scoring_phones(*raws: Column) -> Column:
    """Every 10 to 12 digit number of the cells, distinct, in order."""
    cells = [split_multi(r, SCORING_SPLIT, SCORING_EMPTY_TOKENS) for r in raws]
    numbers = F.transform(F.concat(*cells), _scoring_phone)
    return F.array_distinct(F.filter(numbers, lambda n: n.isNotNull()))


def scoring_emails(*raws: Column) -> Column:
    """Every e-mail address found anywhere in the cells, distinct, in order."""
    found = [
        F.regexp_extract_all(F.coalesce(r, F.lit("")), F.lit(EMAIL_ANYWHERE), F.lit(0))
        for r in raws
    ]
    lowered = F.transform(F.concat(*found), F.lower)
    return F.array_distinct(F.filter(lowered, lambda e: ~e.contains("example.com")))
