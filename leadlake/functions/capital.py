"""Registered capital: parsing to units of 10 000 CNY, and repair of dirty values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.fixed_values import (
    AFFILIATED_BODIES,
    CAPITAL,
    FX,
    REPAIR_CANDIDATE,
    SCORING_CAPITAL,
    SCORING_CURRENCIES,
    SCORING_EMPTY_TOKENS,
    STATE_OWNED,
    STATE_OWNED_PARSER_ONLY,
)
from leadlake.functions.text import any_word, clean, is_empty, let, lookup, strip

AMOUNT = "decimal(24,6)"
RATE = "decimal(12,6)"
MONEY = "decimal(20,2)"
LIMIT_WAN = 500_000_000


def _parts(raw: Column) -> Column:
    """struct(amount, unit, currency, rate); currency is NULL where nothing is stated."""
    bare = F.replace(strip(F.coalesce(raw, F.lit(""))), F.lit(","), F.lit(""))
    found = F.regexp_extract(bare, CAPITAL, 3)
    currency = F.when(bare.rlike(CAPITAL), F.when(found == "", "人民币").otherwise(found))
    return F.struct(
        F.regexp_extract(bare, CAPITAL, 1).try_cast(AMOUNT).alias("amount"),
        F.regexp_extract(bare, CAPITAL, 2).alias("unit"),
        currency.alias("currency"),
        F.coalesce(lookup(FX, currency, RATE), F.lit("1").cast(RATE)).alias("rate"),
    )


def _rate(text: str) -> Column:
    return F.lit(text).cast(RATE)


def _limited(wan: Column) -> Column:
    return F.when(wan <= LIMIT_WAN, F.round(wan, 2).cast(MONEY))


def _state_owned(name: Column, words=STATE_OWNED) -> Column:
    return F.coalesce(any_word(name, words), F.lit(False))


def _wan(p: Column, name: Column) -> Column:
    """Capital of parsed parts. A '万' amount too big to be true is read as yuan."""
    owned = _state_owned(name, STATE_OWNED + STATE_OWNED_PARSER_ONLY)
    converted = p["amount"] * p["rate"]
    too_big = (converted >= 100_000_000) | ((converted >= 10_000_000) & ~owned)
    factor = (
        F.when(p["unit"] == "亿", _rate("10000"))
        .when((p["unit"] == "万") & ~too_big, _rate("1"))
        .otherwise(_rate("0.0001"))
    )
    return _limited(converted * factor)


def capital_currency(raw: Column) -> Column:
    return F.when(~is_empty(raw), _parts(raw)["currency"])


def capital_wan(raw: Column, name: Column) -> Column:
    """Capital in units of 10 000 CNY."""
    return F.when(~is_empty(raw), let(_parts(raw), lambda p: _wan(p, name)))


def needs_repair(raw: Column, wan: Column) -> Column:
    """Rows the repair pass looks at: very large, or very long amounts in '万'."""
    return (raw != "") & wan.isNotNull() & ((wan >= 1_000_000) | raw.rlike(REPAIR_CANDIDATE))


def repair_decision(raw: Column, wan: Column, name: Column, scale: Column) -> Column:
    """struct(capital_wan, capital_currency, reason), NULL where nothing changes.

    The repair may shrink a value or blank it, never enlarge it. Later rules
    win over earlier ones, so they are tested first.
    """
    given = F.struct(
        F.when(~is_empty(raw), _parts(raw)).alias("parsed"), _parts(raw).alias("p"),
        _state_owned(name).alias("owned"), strip(F.coalesce(scale, F.lit(""))).alias("size"),
        F.coalesce(any_word(name, AFFILIATED_BODIES), F.lit(False)).alias("affiliated"),
    )

    def ruled(g: Column) -> Column:
        p, size = g["p"], g["size"]
        yuan = _limited(p["amount"] * p["rate"] * _rate("0.0001"))
        stated_huge = (p["unit"] == "万") & (p["amount"] >= 1_000_000)
        private = ~g["owned"]
        reason = (
            F.when(yuan.isNull(), "parse_capital")
            .when(private & g["affiliated"] & stated_huge, "branch_as_yuan")
            .when((wan >= 1_000_000) & private & ((size == "微型") | g["affiliated"]), "micro_or_branch")
            .when((wan >= 10_000_000) & (private | _small(size)), "ge1000yi_non_soe")
            .otherwise("parse_capital")
        )
        return F.struct(
            reason.alias("reason"), yuan.alias("yuan"), _wan(g["parsed"], name).alias("wan"),
            g["parsed"]["currency"].alias("currency"), p["currency"].alias("yuan_currency"),
            g["owned"].alias("owned"), _small(size).alias("small"),
        )

    def chosen(r: Column) -> Column:
        as_parsed = r["reason"] == "parse_capital"
        return F.struct(
            F.when(as_parsed, r["wan"]).otherwise(r["yuan"]).alias("capital_wan"),
            F.when(as_parsed, r["currency"]).otherwise(r["yuan_currency"]).alias("capital_currency"),
            r["reason"].alias("reason"), r["owned"].alias("owned"), r["small"].alias("small"),
        )

    def decided(c: Column) -> Column:
        new = c["capital_wan"]
        unchanged = (
            (F.abs(wan - new) < 0.02)
            | (new > wan + F.lit("0.02").cast(MONEY))
            | (c["owned"] & (new < wan * _rate("0.5")) & ~c["small"])
        )
        blanked = new.isNull() & (wan >= 1_000_000) & ~c["owned"]
        keep = blanked | (new.isNotNull() & ~F.coalesce(unchanged, F.lit(False)))
        return F.when(
            keep,
            F.struct(
                new.alias("capital_wan"), c["capital_currency"].alias("capital_currency"),
                F.when(blanked, "nullify").otherwise(c["reason"]).alias("reason"),
            ),
        )

    return let(let(let(given, ruled), chosen), decided)


def _small(size: Column) -> Column:
    return size.isin("小型", "微型")


def stated_wan(raw: Column) -> Column:
    """Capital in 10 000 CNY exactly as stated, for profiles of raw data."""
    rates = {k: FX[k] for k in SCORING_CURRENCIES}

    def wan(p: Column) -> Column:
        rate = F.coalesce(lookup(rates, p["currency"], RATE), _rate("1"))
        factor = (
            F.when(p["unit"] == "亿", _rate("10000")).when(p["unit"] == "万", _rate("1"))
            .otherwise(_rate("0.0001"))
        )
        return p["amount"] * rate * factor

    return F.when(~is_empty(raw), let(_parts(raw), wan))


def scoring_capital(raw: Column) -> Column:
    """Capital in CNY as the scoring pipeline reads it (no dirty-unit rule)."""
    text = F.replace(clean(raw, SCORING_EMPTY_TOKENS), F.lit(","), F.lit(""))
    unit = F.regexp_extract(text, SCORING_CAPITAL, 2)
    factor = F.when(unit == "万", 10_000).when(unit == "亿", 100_000_000).otherwise(1)
    rates = {k: FX[k] for k in SCORING_CURRENCIES}
    rate = lookup(rates, F.regexp_extract(text, SCORING_CAPITAL, 3), RATE)
    amount = F.regexp_extract(text, SCORING_CAPITAL, 1).try_cast(AMOUNT)
    return (amount * factor * F.coalesce(rate, _rate("1"))).cast("decimal(32,4)")
