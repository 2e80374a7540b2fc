"""Dates in free text, company age, certificate validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.fixed_values import DATE_TEXT, SCORING_EMPTY_TOKENS, VALID_TO
from leadlake.functions.text import clean, is_empty, let, strip

SERIAL_ZERO = "1899-12-30"
WIDE_DIGITS = "０１２３４５６７８９"


def _plain_digits(c: Column) -> Column:
    return F.translate(c, WIDE_DIGITS, "0123456789")


def _date_by_pattern(text: Column, pattern: str) -> Column:
    year = F.regexp_extract(text, pattern, 1)
    month = F.lpad(F.regexp_extract(text, pattern, 2), 2, "0")
    day = F.lpad(F.regexp_extract(text, pattern, 3), 2, "0")
    day_text = F.concat_ws("-", year, month, day)
    return F.when(year.between("1800", "2100"), day_text.try_cast("date"))


def _serial_date(text: Column, low: int, high: int) -> Column:
    days = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    return F.when(days.between(low, high), F.date_add(F.lit(SERIAL_ZERO).cast("date"), days))


def parse_date(raw: Column) -> Column:
    """A date written as Y-M-D (also / . 年月日) or as a spreadsheet day number.

    Days that do not exist (30 February) give NULL.
    """
    found = let(
        _plain_digits(strip(raw)),
        lambda t: F.coalesce(_date_by_pattern(t, DATE_TEXT), _serial_date(t, 20000, 60000)),
    )
    return F.when(~is_empty(raw), found)


def parse_valid_to(raw: Column) -> Column:
    """End of a validity period '… 至 Y年M月D日', else any date in the text."""
    return F.coalesce(_date_by_pattern(_plain_digits(raw), VALID_TO), parse_date(raw))


def scoring_date(raw: Column) -> Column:
    """The scoring pipeline's date: at the start of the text, or a day number."""
    text = clean(raw, SCORING_EMPTY_TOKENS)
    number = F.regexp_extract(text, r"^([0-9]{4,6})(?:\.[0-9]+)?$", 1)
    pattern = r"^([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})"
    return F.coalesce(_serial_date(number, 20001, 59999), _date_by_pattern(text, pattern))


def years_between(established: Column, as_of: Column) -> Column:
    return (F.datediff(as_of, established) / F.lit(365.25)).cast("double")


def company_age(established: Column, as_of: Column) -> Column:
    """Age in years to one decimal; NULL for a founding date in the future."""
    age = F.round(years_between(established, as_of), 1)
    return F.when(age >= 0, age.cast("decimal(6,1)"))
