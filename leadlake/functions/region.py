"""Province, status and city names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.fixed_values import (
    CITY_ALIASES,
    MUNICIPALITIES,
    PLACEHOLDER_CITIES,
    PROVINCE_BY_NAME,
    PROVINCE_FOLDER,
    REGION_SUFFIXES,
    STATUS_BY_TEXT,
)
from leadlake.functions.text import clean, empty_strings, lookup, strip


def folder_province(folder: Column) -> Column:
    """Province of a source folder such as '江苏所有企业'."""
    return lookup(PROVINCE_BY_NAME, F.regexp_extract(folder, PROVINCE_FOLDER, 1))


def province(raw: Column, folder: Column | None = None) -> Column:
    """Full province name, else the text itself, else the folder's province."""
    options = [lookup(PROVINCE_BY_NAME, clean(raw)), clean(raw)]
    if folder is not None:
        options.append(folder_province(folder))
    return F.coalesce(*options)


def status(raw: Column) -> Column:
    return F.coalesce(lookup(STATUS_BY_TEXT, clean(raw)), clean(raw))


def region_parts(raw: Column) -> Column:
    """struct(province, city, district) of a '省-市-区' text."""
    parts = F.filter(F.transform(F.split(raw, "[-—/]"), strip), lambda p: p != "")
    first = F.try_element_at(parts, F.lit(1))
    prov = F.coalesce(lookup(PROVINCE_BY_NAME, first), first)
    second = F.try_element_at(parts, F.lit(2))
    third = F.try_element_at(parts, F.lit(3))
    short_municipality = prov.isin(*MUNICIPALITIES) & (F.size(parts) == 2)
    return F.struct(
        prov.alias("province"),
        F.when(short_municipality, prov).otherwise(second).alias("city"),
        F.when(short_municipality, second).otherwise(third).alias("district"),
    )


def text(c: Column) -> Column:
    """Trimmed text with '' for NULL: the form used in place-name keys."""
    return strip(F.coalesce(c, F.lit("")))


def is_placeholder_city(city: Column) -> Column:
    return text(city).isin(*PLACEHOLDER_CITIES)


def city_names(city: Column, district: Column) -> Column:
    """Every name under which the city may appear, best one first.

    For placeholder cities the real (county-level) city is the district.
    """
    c, d = text(city), text(district)
    aliases = F.split(lookup({k: "|".join(a) for k, a in CITY_ALIASES.items()}, c), r"\|")
    named = F.filter(F.array(d, c), lambda x: x != "")
    own = F.when(c == "", empty_strings()).otherwise(F.array(c))
    return F.when(is_placeholder_city(c), F.array_distinct(named)).otherwise(
        F.coalesce(aliases, own)
    )


def known_as(city: Column, district: Column) -> Column:
    """Every name by which a record may refer to a division's city.

    The reverse of ``city_names``; a division below a placeholder city is known
    by its district.
    """
    c, d = text(city), text(district)
    names: dict[str, list[str]] = {}
    for name, aliases in CITY_ALIASES.items():
        for alias in aliases:
            names.setdefault(alias, [alias]).append(name)
    referred = lookup({k: "|".join(dict.fromkeys(n)) for k, n in names.items()}, c)
    own = F.coalesce(F.split(referred, r"\|"), F.array(c))
    return F.when(is_placeholder_city(c), F.array_distinct(F.array(d, c))).otherwise(own)


def short_name(c: Column) -> Column:
    """Region name without its administrative suffix."""
    return F.regexp_replace(text(c), f"(?<=.)(?:{'|'.join(REGION_SUFFIXES)})$", "")
