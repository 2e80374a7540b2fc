"""Counts and summaries over companies, contacts, tags and certificates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.fixed_values import HIGH_TECH_TYPE, INDUSTRY_SECTIONS, PROVINCES
from leadlake.functions.text import strip
from leadlake.operators.ranking import numbered, top_per_key

CODE = "credit_code"
CELL_VALUES = 2000


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def filled(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def contact_flags(contacts: DataFrame) -> DataFrame:
    """Flags and counts per company, from its contact points."""
    kinds = contacts.groupBy(CODE).agg(
        count_if(F.col("contact_type") == "mobile").alias("mobile_count"),
        count_if(F.col("contact_type") == "landline").alias("__landlines"),
        count_if(F.col("contact_type") == "email").alias("email_count"),
        F.count(F.lit(1)).alias("__all"),
    )

    def flag(column: str, name: str) -> Column:
        return (F.col(column) > 0).cast("tinyint").alias(name)

    return kinds.select(
        CODE,
        flag("mobile_count", "has_mobile"), flag("__landlines", "has_landline"),
        flag("email_count", "has_email"), flag("__all", "has_contact"),
        F.col("mobile_count").cast("int").alias("mobile_count"),
        F.col("email_count").cast("int").alias("email_count"),
    )


def summary(companies: DataFrame) -> DataFrame:
    """One row: size, reach and averages. Every company weighs once."""
    return companies.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("has_mobile").alias("with_mobile"),
        F.sum("has_landline").alias("with_landline"),
        F.sum("has_email").alias("with_email"),
        F.sum("has_contact").alias("with_contact"),
        F.avg("capital_wan").alias("avg_capital"),
        F.avg("insured_count").alias("avg_insured"),
    )


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """(k, n) of the filled values, most frequent first."""
    counts = df.filter(filled(column)).groupBy(F.col(column).alias("k")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ordered = counts.orderBy(F.desc("n"), "k")
    return ordered.limit(n) if n else ordered


def dimension_counts(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(dim, k, n) of several dimensions in one pass over the table."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(d).alias("dim"), c.cast("string").alias("k"))
                for d, c in dimensions.items()
            ]
        )
    )
    rows = df.select(pairs.alias("pair")).select("pair.*").filter(F.col("k").isNotNull())
    return rows.groupBy("dim", "k").agg(F.count(F.lit(1)).alias("n"))


def company_facets(companies: DataFrame) -> DataFrame:
    """Facet counts: listed provinces and industry sections, scale, status."""
    return dimension_counts(
        companies,
        {
            "province": F.when(F.col("province").isin(*PROVINCES), F.col("province")),
            "industry": F.when(F.col("industry_l1").isin(*INDUSTRY_SECTIONS), F.col("industry_l1")),
            "scale": F.col("scale"),
            "status": F.col("status"),
        },
    )


def chain_facet(tags: DataFrame, n: int = 80) -> DataFrame:
    """Companies per industry chain; packed elements 'A | B' count for each part.

    Equal arrays elements are counted before they are split. Unlike the
    published query nothing is cut before the counts are final.
    """
    raw = tags.select(F.explode("chain_industries").alias("raw")).filter(filled("raw"))
    counted = raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    parts = F.filter(F.transform(F.split("raw", r"\|"), strip), lambda p: p != "")
    chains = counted.select(F.explode(parts).alias("k"), "n")
    totals = chains.groupBy("k").agg(F.sum("n").alias("n"))
    return totals.orderBy(F.desc("n"), "k").limit(n)


def region_counts(companies: DataFrame, level: str, within: dict[str, str], n: int | None = None) -> DataFrame:
    """Companies per region of one level inside the given upper regions, all or the first n."""
    chosen = companies
    for column, name in within.items():
        chosen = chosen.filter(F.col(column) == name)
    return value_counts(chosen, level, n)


def contact_preview(companies: DataFrame, contacts: DataFrame, n: int = 3) -> DataFrame:
    """Up to n phones per company, primary ones first, as an array column.

    ``companies`` is a page of results: its keys filter the contacts before
    anything is ranked.
    """
    phones = contacts.filter(F.col("contact_type").isin("mobile", "landline"))
    phones = phones.join(companies.select(CODE), CODE, "left_semi")
    order = [F.desc("is_primary"), F.asc("contact_type"), F.asc("contact_value")]
    first = top_per_key(phones, [CODE], order, n)
    item = F.struct(
        (-F.col("is_primary")).alias("o"), "contact_type", "contact_value"
    )
    bundled = first.groupBy(CODE).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    shown = F.transform("__items", lambda x: F.struct(x["contact_type"], x["contact_value"]))
    empty = F.array().cast("array<struct<contact_type:string,contact_value:string>>")
    return (
        companies.join(bundled, CODE, "left")
        .withColumn("contacts_preview", F.coalesce(shown, empty))
        .drop("__items")
    )


def contact_lists(contacts: DataFrame, cell_values: int = CELL_VALUES) -> DataFrame:
    """(credit_code, part, mobiles, landlines, emails): contacts as ';' lists.

    Primary contacts come first, then by value. A company with more than
    ``cell_values`` contacts of a type continues in part 2, 3, …, so that no
    cell and no task has to hold an unbounded list; nothing is left out.
    """
    value = strip(F.coalesce(F.col("contact_value"), F.lit("")))
    points = (
        contacts.select(
            CODE, F.lower("contact_type").alias("contact_type"), value.alias("contact_value"),
            "is_primary",
        )
        .filter((F.col("contact_value") != "") & F.col("contact_type").isin("mobile", "landline", "email"))
        .groupBy(CODE, "contact_type", "contact_value")
        .agg(F.max("is_primary").alias("is_primary"))
    )
    coarse = F.concat(F.lit(1) - F.col("is_primary"), F.substring("contact_value", 1, 6))
    order = [F.desc("is_primary"), F.asc("contact_value")]
    placed = numbered(points, [CODE, "contact_type"], coarse, order)
    part = (F.floor((F.col("position") - 1) / cell_values) + 1).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("position", "contact_value")))
    cells = placed.groupBy(CODE, "contact_type", part.alias("part")).agg(
        F.array_join(F.transform(ordered, lambda x: x["contact_value"]), ";").alias("cell")
    )

    def of(kind: str, name: str) -> Column:
        cell = F.max(F.when(F.col("contact_type") == kind, F.col("cell")))
        return F.coalesce(cell, F.lit("")).alias(name)

    return cells.groupBy(CODE, "part").agg(
        of("mobile", "mobiles"), of("landline", "landlines"), of("email", "emails")
    )


def map_clusters(companies: DataFrame, level: str, box, n: int) -> DataFrame:
    """Companies per region with centre point; regions centred in the box only.

    Regions are counted whole, also where they extend beyond the box.
    """
    levels = ["city", "district", "street"]
    groups = levels[: levels.index(level) + 1]
    located = companies.filter(F.col("lng").isNotNull() & F.col("lat").isNotNull() & filled(level))
    clusters = located.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.round(F.avg("capital_wan"), 1).cast("double").alias("metric"),
        F.avg("lng").alias("lng"),
        F.avg("lat").alias("lat"),
        F.sum("has_mobile").alias("with_mobile"),
    )
    seen = F.col("lng").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])
    named = clusters.filter(seen).withColumn("name", F.col(level))
    return named.orderBy(F.desc("cnt"), *groups).limit(n)


def reach_rates(companies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of companies with each kind of contact, in percent."""

    def rate(flag: str, name: str) -> Column:
        return F.round(F.sum(flag) * 100 / F.count(F.lit(1)), 2).cast("double").alias(name)

    return companies.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        rate("has_mobile", "mobile_pct"), rate("has_landline", "landline_pct"),
        rate("has_email", "email_pct"), rate("has_contact", "any_pct"),
    )


def valid_certificates(qualifications: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Certificates in force: of the high-tech type, not revoked, not expired
    on ``as_of`` where that is given."""
    valid = qualifications.filter(
        (F.col("qual_type") == HIGH_TECH_TYPE) & (F.col("revoked") == 0)
    )
    return valid if as_of is None else valid.filter(F.col("valid_to") >= as_of)


def revoked_timeline(qualifications: DataFrame, n: int) -> DataFrame:
    """Companies that lost a certificate, with the most certificates first."""
    lines = qualifications.filter(F.col("qual_type") == HIGH_TECH_TYPE)
    per_company = lines.groupBy(CODE).agg(
        F.count(F.lit(1)).alias("certs"), F.sum("revoked").alias("revoked_n")
    )
    return per_company.filter(F.col("revoked_n") > 0).orderBy(F.desc("certs"), CODE).limit(n)


def capital_magnitudes(companies: DataFrame) -> DataFrame:
    wan = F.col("capital_wan")
    return companies.agg(
        count_if(wan >= 100_000_000).alias("ge_1e8"),
        count_if((wan >= 10_000_000) & (wan < 100_000_000)).alias("ge_1e7"),
        count_if((wan >= 1_000_000) & (wan < 10_000_000)).alias("ge_1e6"),
    )


def health(companies: DataFrame) -> DataFrame:
    """Table size, located and street-resolved companies, and what is left to locate."""
    located = F.col("lng").isNotNull() & F.col("lat").isNotNull()
    open_case = F.col("lng").isNull() & (F.col("status") == "存续")
    return companies.agg(
        F.count(F.lit(1)).alias("companies"),
        count_if(located).alias("geocoded"),
        count_if(filled("street")).alias("with_street"),
        count_if(open_case).alias("to_locate"),
        count_if(open_case & filled("street")).alias("to_locate_with_street"),
    )


def sparse_and_rich(companies: DataFrame, tags: DataFrame) -> DataFrame:
    """Companies with neither intro nor tags, and with both."""
    tagged = tags.select(CODE).distinct().withColumn("__tagged", F.lit(True))
    marked = companies.select(CODE, "intro").join(tagged, CODE, "left")
    has_tags, has_intro = F.col("__tagged").isNotNull(), filled("intro")
    return marked.agg(
        count_if(~has_tags & ~F.coalesce(has_intro, F.lit(False))).alias("sparse"),
        count_if(has_tags & has_intro).alias("rich"),
    )


def division_levels(divisions: DataFrame) -> DataFrame:
    """Divisions of each level, how many of them have a centre, and how many provinces they lie in."""
    located = F.col("center_lng").isNotNull() & F.col("center_lat").isNotNull()
    return divisions.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), count_if(located).alias("located"), F.countDistinct("province").alias("provinces")
    )


def certified_coverage(companies: DataFrame, qualifications: DataFrame) -> DataFrame:
    """Certified companies, and how many of them the registry knows."""
    certified = valid_certificates(qualifications).select(CODE).distinct()
    known = companies.select(CODE, F.lit(1).alias("__known"))
    return certified.join(known, CODE, "left").agg(
        F.count(F.lit(1)).alias("certified"), F.count("__known").alias("in_registry")
    )


def person_names(companies: DataFrame, prefix: str, n: int = 10) -> DataFrame:
    return value_counts(companies.filter(F.col("legal_person").startswith(prefix)), "legal_person", n)
