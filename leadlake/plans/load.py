"""Loads: registry, monthly, chain, national and certificate sources to tables.

Each function takes mapped rows (text columns with internal field names, see
``leadlake.sources.headers``) and returns tables; nothing is written here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.fixed_values import HIGH_TECH_HONOR, HIGH_TECH_TYPE
from leadlake.functions import contacts as ct
from leadlake.functions import dates, identity, region, tags
from leadlake.functions.capital import capital_currency, capital_wan
from leadlake.functions.text import byte_truncate, clean, empty_strings, filled_count, is_empty, split_multi
from leadlake.operators.lists import key_lists
from leadlake.operators.ranking import keep_best, top_per_key
from leadlake.operators.upsert import fill_blanks
from leadlake.schemas import CERTIFICATE_KEY, CONTACT_KEY
from leadlake.sources.headers import MONTHLY

CODE = "credit_code"
MONTHLY_BONUS = 300
INSURED_CAP = 2_000_000

# Fields a source may fill in, by source.
CHAIN_FIELDS = (
    "company_name", "status", "legal_person", "scale", "capital_wan", "capital_raw",
    "capital_currency", "capital_paid_wan", "established", "approved", "term_raw",
    "province", "city", "district", "company_type", "industry_l1", "industry_l2",
    "industry_l3", "industry_l4", "insured_count", "insured_year", "former_name", "en_name",
    "tax_id", "reg_no", "org_code", "address", "address_report", "address_mail", "website",
    "scope", "registrar", "taxpayer_qual", "intro", "report_year",
)
NATIONAL_FIELDS = (
    "company_name", "status", "legal_person", "capital_wan", "capital_raw",
    "capital_currency", "capital_paid_wan", "established", "approved", "term_raw",
    "province", "city", "district", "company_type", "industry_l1", "insured_count",
    "former_name", "tax_id", "reg_no", "org_code", "address", "website", "scope",
)
CERTIFICATE_FIELDS = (
    "company_name", "status", "legal_person", "capital_wan", "capital_raw",
    "capital_currency", "established", "province", "city", "district", "company_type",
    "industry_l1", "industry_l2", "address", "website", "scope",
)
# Text columns with a byte limit: column -> (field, limit).
LIMITED = {
    "legal_person": ("legal", 128), "capital_raw": ("capital", 64), "term_raw": ("term", 64),
    "company_type": ("type", 128), "industry_l1": ("ind1", 64), "industry_l2": ("ind2", 64),
    "industry_l3": ("ind3", 64), "industry_l4": ("ind4", 64), "insured_year": ("insured_year", 8),
    "former_name": ("former", 500), "en_name": ("en_name", 500), "tax_id": ("tax_id", 32),
    "reg_no": ("reg_no", 32), "org_code": ("org_code", 32), "address": ("address", 500),
    "address_report": ("address_report", 500), "website": ("website", 300),
    "registrar": ("registrar", 200), "taxpayer_qual": ("taxpayer_qual", 64),
    "report_year": ("report_year", 8),
}


def _cut(limits: bool, c: Column, limit: int) -> Column:
    return byte_truncate(c, limit) if limits else c


def _field(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast("string")


def company_columns(
    rows: DataFrame, normalised: bool, strict_staff: bool, by_folder: bool = False, limits: bool = False
) -> dict[str, Column]:
    """Target columns computed from the fields of a source.

    ``normalised`` maps status and province spellings, ``by_folder`` lets the
    source folder name a missing province, ``strict_staff`` accepts staff counts
    made of digits only. ``limits`` cuts text columns to the published byte limits
    and caps strict staff counts; without it values are whole and strict counts long.
    """
    f = {n: _field(rows, n) for n in ("capital", "capital_paid", "established", "approved")}
    name = _cut(limits, clean(_field(rows, "name")), 300)
    folder = F.col("src_group") if by_folder and "src_group" in rows.columns else None
    status, province = clean(_field(rows, "status")), clean(_field(rows, "province"))
    if normalised:
        status = region.status(_field(rows, "status"))
        province = region.province(_field(rows, "province"), folder)
    staff = clean(_field(rows, "insured"))
    if strict_staff:
        number = F.when(staff.rlike("^[0-9]+$"), staff.try_cast("long"))
        number = F.least(number, F.lit(INSURED_CAP)).cast("int") if limits else number
    else:
        number = ct.digits(staff).try_cast("int" if limits else "long")
    out = {
        "company_name": name,
        "status": _cut(limits, status, 32),
        "scale": _cut(limits, clean(_field(rows, "scale")), 16),
        "capital_wan": capital_wan(f["capital"], name),
        "capital_currency": _cut(limits, capital_currency(f["capital"]), 16),
        "capital_paid_wan": capital_wan(f["capital_paid"], name),
        "established": dates.parse_date(f["established"]),
        "approved": dates.parse_date(f["approved"]),
        "province": _cut(limits, province, 32),
        "city": _cut(limits, clean(_field(rows, "city")), 64),
        "district": _cut(limits, clean(_field(rows, "district")), 64),
        "insured_count": number,
        "address_mail": ct.mail_addresses(_field(rows, "address_mail")),
        "intro": clean(_field(rows, "intro")),
        "scope": clean(_field(rows, "scope")),
    }
    for column, (field, limit) in LIMITED.items():
        out[column] = _cut(limits, clean(_field(rows, field)), limit)
    return out


def _contact_rows(
    rows: DataFrame, items: Column, arrival: list[str], source: str, collected_at: Column
) -> DataFrame:
    """One row per contact item; ``pos`` keeps the order inside the row."""
    exploded = rows.select(CODE, "company_name", *arrival, F.posexplode(items).alias("pos", "item"))
    return exploded.select(
        CODE, "item.*", F.lit(source).alias("source"), "company_name",
        collected_at.alias("collected_at"), "pos", *arrival,
    )


def _items(values: Column, kind: str, first_is_primary: bool) -> Column:
    return F.transform(
        values,
        lambda v, i: F.struct(
            F.lit(kind).alias("contact_type"), v.alias("contact_value"),
            (F.when(i == 0, 1).otherwise(0) if first_is_primary else F.lit(0))
            .cast("tinyint").alias("is_primary"),
        ),
    )


def _unique_contacts(rows: DataFrame, arrival: list[str], first_wins: bool) -> DataFrame:
    order = [F.asc(a) if first_wins else F.desc(a) for a in (*arrival, "pos")]
    return top_per_key(rows, CONTACT_KEY, order, 1).drop("pos", *arrival)


# --- registry ---------------------------------------------------------------------


def keyed_registry(rows: DataFrame, limits: bool = False) -> DataFrame:
    """Registry rows with a name, their company key and their completeness score.

    Only what ranks a row is computed here; the fields are cleaned after the
    best row per company is known.
    """
    fields = [c for c in rows.columns if c not in ("src_group", "src_file", "row_no")]
    name = _cut(limits, clean(F.col("name")), 300)
    return rows.filter(~is_empty(F.col("name"))).select(
        identity.entity_code(F.col("credit"), name).alias(CODE), name.alias("company_name"),
        filled_count([F.col(c) for c in fields]).alias("fill_score"), *rows.columns,
    )


def _contact_arrays(rows: DataFrame) -> dict[str, Column]:
    return {
        "mobiles": ct.mobiles(_field(rows, "mobile"), _field(rows, "landline")),
        "landlines": ct.landlines(_field(rows, "landline")),
        "emails": ct.emails(_field(rows, "email"), _field(rows, "email2")),
    }


def registry_companies(keyed: DataFrame, as_of: Column, arrival: list[str], limits: bool = False) -> DataFrame:
    """The fullest row per company over all files, cleaned; the earliest of equals."""
    best = keep_best(keyed, [CODE], "fill_score", arrival)
    columns = company_columns(best, normalised=True, strict_staff=True, by_folder=True, limits=limits)
    del columns["company_name"]
    kept = [c for c in ("src_group", "src_file", "row_no") if c in best.columns]
    cleaned = best.select(
        CODE, "company_name", *[c.alias(n) for n, c in columns.items()],
        *[F.size(a).alias(n) for n, a in _contact_arrays(best).items()], "fill_score", *kept,
    )
    age = dates.company_age(F.col("established"), as_of)
    founded = F.when(age.isNotNull(), F.col("established"))
    reached = F.col("mobiles") + F.col("landlines") + F.col("emails")
    return cleaned.withColumns(
        {
            "company_age": age,
            "established_year": F.year(founded).cast("smallint"),
            "established": founded,
            "has_mobile": (F.col("mobiles") > 0).cast("tinyint"),
            "has_landline": (F.col("landlines") > 0).cast("tinyint"),
            "has_email": (F.col("emails") > 0).cast("tinyint"),
            "has_contact": (reached > 0).cast("tinyint"),
            "mobile_count": F.col("mobiles"),
            "email_count": F.col("emails"),
        }
    ).drop("mobiles", "landlines", "emails")


def registry_contacts(keyed: DataFrame, arrival: list[str], source: str, collected_at: Column) -> DataFrame:
    """Contact points of all rows; the first of each type in a row is primary."""
    arrays = _contact_arrays(keyed)
    items = F.concat(
        _items(arrays["mobiles"], "mobile", True),
        _items(arrays["landlines"], "landline", True),
        _items(arrays["emails"], "email", True),
    )
    rows = _contact_rows(keyed, items, arrival, source, collected_at)
    return _unique_contacts(rows, arrival, first_wins=True)


# --- monthly increment ---------------------------------------------------------------


def monthly_companies(rows: DataFrame, as_of: Column, arrival: list[str], limits: bool = False) -> DataFrame:
    """Several rows per company, one mobile each, folded to one company row.

    The fullest row gives the fields; flags and counts cover the mobiles of all
    rows. Scores start at 300 so that the increment replaces registry rows.
    """
    name = _cut(limits, clean(F.col("name")), 300)
    keyed = rows.filter(~is_empty(F.col("name"))).select(
        identity.entity_code(F.col("credit"), name).alias(CODE),
        (filled_count([F.col(c) for c in MONTHLY]) + MONTHLY_BONUS).alias("fill_score"), *rows.columns,
    )
    best = keep_best(keyed, [CODE], "fill_score", arrival)
    place = region.region_parts(F.col("region"))
    columns = company_columns(best, normalised=True, strict_staff=True, limits=limits)
    columns |= {n: _cut(limits, place[n], 64) for n in ("province", "city", "district")}
    cleaned = best.select(CODE, *[c.alias(n) for n, c in columns.items()], "fill_score", *arrival)
    cleaned = cleaned.withColumn("company_age", dates.company_age(F.col("established"), as_of))
    numbers = keyed.select(CODE, F.explode(ct.mobiles(F.col("mobile"), F.lit(""))).alias("mobile")).distinct()
    counts = numbers.groupBy(CODE).agg(F.count(F.lit(1)).cast("int").alias("mobile_count"))
    reached = (F.coalesce("mobile_count", F.lit(0)) > 0).cast("tinyint")
    return cleaned.join(counts, CODE, "left").withColumns(
        {
            "established_year": F.year("established").cast("smallint"),
            "has_mobile": reached, "has_landline": F.lit(0).cast("tinyint"),
            "has_email": F.lit(0).cast("tinyint"), "has_contact": reached,
            "mobile_count": F.coalesce("mobile_count", F.lit(0)), "email_count": F.lit(0),
        }
    )


# --- enrichment ------------------------------------------------------------------------


def _enrichment(rows: DataFrame, fields, arrival: list[str], normalised: bool, limits: bool) -> DataFrame:
    """The fullest row per valid code, with its own completeness as ``own_score``."""
    coded = rows.withColumn("credit", identity.normal_code(F.col("credit")))
    coded = coded.filter(identity.is_credit_code(F.col("credit")))
    columns = company_columns(coded, normalised, strict_staff=False, limits=limits)
    name = F.coalesce(columns["company_name"], F.col("credit"))
    kept = [c for c in ("mobile", "landline", "phone", "email", "email2") if c in rows.columns]
    selected = coded.select(
        F.col("credit").alias(CODE), name.alias("company_name"),
        *[columns[c].alias(c) for c in fields if c != "company_name"], *kept, *arrival,
    )
    filled = [F.coalesce((F.col(c).cast("string") != ""), F.lit(False)).cast("int") for c in (CODE, *fields)]
    scored = selected.withColumn("own_score", reduce(lambda a, b: a + b, filled))
    return keep_best(scored, [CODE], "own_score", arrival)


def chain_enrichment(rows: DataFrame, arrival: list[str], limits: bool = False) -> DataFrame:
    return _enrichment(rows, CHAIN_FIELDS, arrival, normalised=False, limits=limits)


def national_enrichment(rows: DataFrame, arrival: list[str], limits: bool = False) -> DataFrame:
    named = rows.filter(~is_empty(F.col("name")))
    return _enrichment(named, NATIONAL_FIELDS, arrival, normalised=True, limits=limits)


def certificate_enrichment(rows: DataFrame, arrival: list[str], limits: bool = False) -> DataFrame:
    named = rows.filter(~is_empty(F.col("name")))
    return _enrichment(named, CERTIFICATE_FIELDS, arrival, normalised=True, limits=limits)


def enrich_from_chain(companies: DataFrame, source: DataFrame) -> DataFrame:
    return fill_blanks(companies, source, CHAIN_FIELDS, 50)


def enrich_from_national(companies: DataFrame, source: DataFrame) -> DataFrame:
    return fill_blanks(companies, source, NATIONAL_FIELDS, "own_score")


def enrich_from_certificates(companies: DataFrame, source: DataFrame) -> DataFrame:
    return fill_blanks(companies, source, CERTIFICATE_FIELDS, 20)


def _phone_item(part: Column, primary: Column) -> Column:
    number = ct.digits(part)
    mobile = ct.is_mobile(number)
    return F.struct(
        F.when(mobile, "mobile").otherwise("landline").alias("contact_type"),
        F.when(mobile, number).otherwise(ct.landline(part)).alias("contact_value"),
        F.when(mobile & primary, 1).otherwise(0).cast("tinyint").alias("is_primary"),
    )


def _email_items(*cells: Column) -> Column:
    parts = F.transform(F.concat(*[split_multi(c) for c in cells]), F.lower)
    return _items(F.filter(parts, ct.is_email), "email", False)


def enrichment_contacts(
    source: DataFrame, arrival: list[str], name: str, collected_at: Column, primary: str = "first_cell"
) -> DataFrame:
    """Contacts of enrichment rows; the last of equal ones stays.

    ``primary``: 'first_cell' marks the first part of the phone cell if it is a
    mobile, 'first_mobile' the first mobile, 'none' nothing.
    """
    phones = split_multi(_field(source, "mobile" if "mobile" in source.columns else "phone"))
    if primary == "first_mobile":
        number = F.filter(phones, lambda p: ct.is_mobile(ct.digits(p)))
        phones = F.concat(number, F.filter(phones, lambda p: ~ct.is_mobile(ct.digits(p))))
    is_first = F.lit(primary != "none")
    items = F.concat(
        F.transform(phones, lambda p, i: _phone_item(p, is_first & (i == 0))),
        F.transform(split_multi(_field(source, "landline")), lambda p: _phone_item(p, F.lit(False))),
        _email_items(_field(source, "email"), _field(source, "email2")),
    )
    usable = F.filter(items, lambda x: x["contact_value"].isNotNull())
    keyed = _contact_rows(source, usable, arrival, name, collected_at)
    return _unique_contacts(keyed, arrival, first_wins=False)


# --- industry-chain tags -----------------------------------------------------------------


def chain_tag_rows(rows: DataFrame, limits: bool = False) -> DataFrame:
    """Tag fields of chain rows with a valid code."""
    levels = tags.chain_levels(*[_field(rows, f"l{i}") for i in range(1, 9)])
    folder = F.col("src_group") if "src_group" in rows.columns else F.lit("")
    coded = rows.withColumn("credit", identity.normal_code(F.col("credit")))
    kept = [c for c in ("src_file", "row_no") if c in rows.columns]
    return coded.filter(identity.is_credit_code(F.col("credit"))).select(
        F.col("credit").alias(CODE),
        _cut(limits, F.coalesce(clean(_field(rows, "name")), F.col("credit")), 300).alias("company_name"),
        tags.chain_industry(levels, folder).alias("industry"),
        tags.chain_path(levels, _field(rows, "node")).alias("node_path"),
        clean(_field(rows, "position")).alias("position"),
        clean(_field(rows, "relatedness")).alias("relatedness"),
        clean(_field(rows, "financing")).alias("financing"),
        tags.honors(_field(rows, "honors")).alias("honors"),
        *kept,
    )


def _wrapped(c: Column) -> Column:
    return F.when(c.isNotNull(), F.array(c)).otherwise(empty_strings())


def merge_tags(existing: DataFrame, rows: DataFrame, arrival: list[str]) -> DataFrame:
    """Tags of all companies after chain rows are merged in.

    Lists are united, old values first; positions likewise; the closest
    relation and the last financing win. Scores of existing tags stay.
    """
    order = F.struct(*arrival)
    old = existing.select(
        CODE, "company_name", tags.unpack(F.col("chain_industries")).alias("industries"),
        tags.unpack(F.col("chain_nodes")).alias("nodes"), tags.unpack(F.col("honors")).alias("honors"),
        F.col("chain_positions").alias("position"), "relatedness",
        F.col("financing_raw").alias("financing"), F.lit(0).alias("incoming"),
        F.lit(None).cast(dict(rows.select(order.alias("o")).dtypes)["o"]).alias("arrival"),
    )
    new = rows.select(
        CODE, "company_name", _wrapped(F.col("industry")).alias("industries"),
        _wrapped(F.col("node_path")).alias("nodes"), "honors", "position", "relatedness",
        "financing", F.lit(1).alias("incoming"), order.alias("arrival"),
    )
    rank, incoming = tags.relatedness_rank(F.col("relatedness")), F.col("incoming") == 1
    # Single values are further kinds of the same grouping: each source is read once.
    items = [
        ("industries", F.col("industries"), 0), ("nodes", F.col("nodes"), 0), ("new_honors", F.col("honors"), 0),
        ("positions", tags.positions(F.coalesce("position", F.lit(""))), 0),
        ("new_name", _wrapped(F.when(incoming, F.col("company_name"))), F.coalesce(-F.length("company_name"), F.lit(0))),
        ("new_relatedness", _wrapped(F.when(rank.isNotNull(), F.col("relatedness"))), F.coalesce(-rank, F.lit(0))),
        ("new_financing", _wrapped(F.col("financing")), 0), ("touched", _wrapped(F.when(incoming, F.lit("x"))), 0),
    ]
    merged = key_lists(
        old.unionByName(new), CODE, items, F.struct("incoming", "arrival"),
        ("industries", "nodes", "new_honors", "positions"), ("new_name", "new_relatedness", "touched"), ("new_financing",),
    )
    joined = existing.join(merged, CODE, "full")
    touched = F.col("touched").isNotNull()

    def listed(c: str) -> Column:
        return F.when(F.size(c) > 0, F.col(c))

    new_values = {
        "company_name": F.coalesce("new_name", "company_name"),
        "chain_industries": listed("industries"), "chain_nodes": listed("nodes"),
        "honors": listed("new_honors"), "chain_positions": F.array_join(listed("positions"), "、"),
        "relatedness": F.col("new_relatedness"), "financing_raw": F.col("new_financing"),
        "tag_finance": F.coalesce(tags.finance_tag(F.col("new_financing")), F.col("tag_finance")),
    }
    return joined.select(
        *[
            F.when(touched, new_values[c]).otherwise(F.col(c)).alias(c) if c in new_values else F.col(c)
            for c in existing.columns
        ]
    )


def add_honor(existing: DataFrame, certified: DataFrame, honor: str = HIGH_TECH_HONOR) -> DataFrame:
    """Append an honour to the tags of certified companies, adding missing rows."""
    names = certified.groupBy(CODE).agg(F.max("company_name").alias("certified_name"))
    joined = existing.join(names.withColumn("__certified", F.lit(True)), CODE, "full")
    honors = F.concat(F.coalesce("honors", empty_strings()), F.array(F.lit(honor)))
    touched = F.col("__certified").isNotNull()
    new = {
        "company_name": F.coalesce(F.when(F.col("company_name") != "", F.col("company_name")), "certified_name"),
        "honors": tags.distinct_values(honors),
    }
    return joined.select(
        *[F.when(touched, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in existing.columns]
    )


# --- certificates --------------------------------------------------------------------------


def certificates(rows: DataFrame, source: str, arrival: list[str], year: str | None = None, limits: bool = False) -> DataFrame:
    """Certificate rows, the last one per (company, type, number)."""
    given = _field(rows, "year") if year is None else F.lit(year)
    code = identity.normal_code(F.col("credit"))
    kept = rows.filter(~is_empty(F.col("name"))).withColumn("credit", code)
    kept = kept.filter(identity.is_credit_code(F.col("credit")))
    lines = kept.select(
        F.col("credit").alias(CODE), F.lit(HIGH_TECH_TYPE).alias("qual_type"),
        _cut(
            limits, tags.certificate_number(_field(rows, "cert_no"), clean(given), F.col("credit")), 64
        ).alias("cert_no"),
        _cut(limits, clean(F.col("name")), 300).alias("company_name"),
        clean(given).alias("cert_year"),
        dates.parse_date(_field(rows, "issue_date")).alias("issue_date"),
        dates.parse_valid_to(_field(rows, "valid_to")).alias("valid_to"),
        tags.is_revoked(_field(rows, "revoked")).alias("revoked"),
        F.lit(source).alias("source"), *arrival,
    )
    return top_per_key(lines, CERTIFICATE_KEY, [F.desc(a) for a in arrival], 1).drop(*arrival)
