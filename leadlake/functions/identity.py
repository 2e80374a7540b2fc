"""Company keys: strict 18-character codes and surrogates made from names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.fixed_values import CREDIT_CODE, SCORING_EMPTY_TOKENS
from leadlake.functions.text import clean, strip


def normal_code(raw: Column) -> Column:
    """Upper case, no blanks."""
    return F.replace(F.upper(strip(F.coalesce(raw, F.lit("")))), F.lit(" "), F.lit(""))


def is_credit_code(code: Column) -> Column:
    return F.coalesce(code.rlike(CREDIT_CODE), F.lit(False))


def surrogate_code(name: Column) -> Column:
    """'N' and 17 hex digits of the name: as long as a real code."""
    return F.concat(F.lit("N"), F.upper(F.substring(F.md5(name), 1, 17)))


def entity_code(raw: Column, name: Column) -> Column:
    code = normal_code(raw)
    return F.when(is_credit_code(code), code).otherwise(surrogate_code(name))


def scoring_key(raw: Column, name: Column) -> Column:
    """Key of the scoring pipeline: the code, else 'N:' and the name, else NULL."""
    code = normal_code(clean(raw, SCORING_EMPTY_TOKENS))
    valid = is_credit_code(code) & (code != "0" * 18)
    named = clean(name, SCORING_EMPTY_TOKENS)
    return F.when(valid, code).otherwise(F.concat(F.lit("N:"), named))
