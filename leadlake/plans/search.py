"""End-user queries: search, statistics, facets, regions, map, export, detail, tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.fixed_values import CORE_PROVINCES
from leadlake.operators import aggregates as agg
from leadlake.operators import predicates as pred
from leadlake.operators.divisions import streets_with_counts
from leadlake.operators.nearby import around
from leadlake.operators.predicates import CompanyFilter, select_companies
from leadlake.operators.ranking import page
from leadlake.schemas import Tables
from leadlake.sources.exports import export_rows

CODE = "credit_code"
SORTABLE = (
    "capital_wan", "company_age", "insured_count", "established_year", "company_name",
    "established", "mobile_count", "fill_score",
)
MAX_PAGE = 200
CARD = (
    "credit_code", "company_name", "status", "legal_person", "scale", "capital_wan",
    "capital_raw", "established", "company_age", "province", "city", "district", "street",
    "company_type", "industry_l1", "industry_l2", "industry_l3", "insured_count", "address",
    "has_mobile", "has_landline", "has_email", "has_contact", "mobile_count", "email_count",
    "website", "lng", "lat",
)
MAP_CARD = (
    "credit_code", "company_name", "legal_person", "status", "scale", "capital_wan",
    "province", "city", "district", "street", "industry_l1", "address", "has_mobile",
    "has_contact", "lng", "lat", "insured_count",
)


def name_rank(text: str):
    """Exact names first, then names that start with the text, then shorter ones."""
    name = F.col("company_name")
    return [F.desc(name == text), F.desc(name.startswith(text)), F.asc(F.char_length(name))]


def search_order(text: str, dimensions: str, sort: str, descending: bool):
    column = sort if sort in SORTABLE else "capital_wan"
    by_value = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    chosen = pred.chosen_dimensions(dimensions)
    named = "company" in chosen if chosen else pred.classify_text(text) in ("company", "keyword", "person")
    ranked = name_rank(text.strip()) if text.strip() and named else []
    return [*ranked, by_value, F.asc(CODE)]


def search(
    tables: Tables, f: CompanyFilter = CompanyFilter(), text: str = "", dimensions: str = "",
    number: int = 1, size: int = 20, sort: str = "capital_wan", descending: bool = True,
) -> dict[str, DataFrame]:
    """One page of companies with phone previews, and the total.

    The page (at most 200 rows) is kept in memory while the previews are joined.
    """
    if number < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError("page out of range")
    found = select_companies(tables, f, text, dimensions)
    order = search_order(text, dimensions, sort, descending)
    have = set(found.columns)
    cards = [F.col(c) for c in CARD if c in have]
    if "scope" in have:
        cards.append(F.substring("scope", 1, 200).alias("scope_preview"))
    items = page(found, order, number, size).select(*cards)
    if tables.contacts is not None:
        items = agg.contact_preview(items, tables.contacts)
    return {"items": items, "total": found.agg(F.count(F.lit(1)).alias("total"))}


def statistics(tables: Tables, f: CompanyFilter = CompanyFilter(), text: str = "", dimensions: str = "") -> dict[str, DataFrame]:
    found = select_companies(tables, f, text, dimensions)
    return {
        "summary": agg.summary(found),
        "by_province": agg.value_counts(found, "province", 12),
        "by_industry": agg.value_counts(found, "industry_l1", 12),
    }


def facets(tables: Tables) -> dict[str, DataFrame]:
    return {
        "companies": agg.company_facets(tables.companies),
        "chains": agg.chain_facet(tables.tags),
    }


def cities(tables: Tables, province: str = "", limit: int | None = None) -> DataFrame:
    """Cities of a province; without one, those of the four core provinces."""
    if province:
        return agg.region_counts(tables.companies, "city", {"province": province}, limit)
    core = F.col("province").isin(*CORE_PROVINCES)
    return agg.value_counts(tables.companies.filter(core), "city", limit)


def districts(tables: Tables, province: str, city: str, limit: int | None = None) -> DataFrame:
    return agg.region_counts(tables.companies, "district", {"province": province, "city": city}, limit)


def streets(tables: Tables, province: str, city: str, district: str) -> DataFrame:
    here = (F.col("province") == province) & (F.col("city") == city) & (F.col("district") == district)
    listed = streets_with_counts(tables.companies.filter(here), tables.divisions)
    return listed.select("k", "n")


def nearby(
    tables: Tables, lng: float, lat: float, radius_m: float = 1000, has_mobile: int | None = 1,
    status: str = "存续", industry_l1: str = "", user: str = "default", limit: int = 100,
) -> DataFrame:
    """Companies around a point: unmarked ones first, then the nearest.

    Companies the user has blocked or contacted carry the flag 'blocked'.
    All companies within the radius are considered.
    """
    f = CompanyFilter(status=status, has_mobile=has_mobile, industry_l1=industry_l1)
    near = around(tables.companies.filter(pred.company_predicate(f)), lng, lat, radius_m)
    marked = pred.status_keys(tables.contact_status, user, ("blocked", "contacted"))
    flagged = near.join(marked.withColumn("__marked", F.lit("blocked")), CODE, "left")
    out = flagged.withColumn("contact_flag", F.coalesce("__marked", F.lit(""))).drop("__marked")
    order = [
        F.asc(F.col("contact_flag") != ""), F.asc("distance_m"), F.desc_nulls_last("capital_wan"),
        F.asc(CODE),
    ]
    return out.orderBy(*order).limit(limit)


def map_level(zoom: float) -> tuple[str, int]:
    if zoom < 10:
        return "city", 40
    return ("district", 80) if zoom < 12.5 else ("street", 120)


def map_clusters(tables: Tables, box, zoom: float, f: CompanyFilter = CompanyFilter(has_mobile=1), text: str = "") -> dict[str, DataFrame] | None:
    """Clusters of the zoom's level and the number of companies in the box.

    None stands for the overview shown when the box is too wide.
    """
    pred.checked_box(box)
    if pred.too_wide(box):
        return None
    found = select_companies(tables, f, text)
    level, n = map_level(zoom)
    inside = pred.located(found, box)
    return {
        "clusters": agg.map_clusters(found, level, box, n),
        "total": inside.agg(F.count(F.lit(1)).alias("total")),
    }


def map_companies(
    tables: Tables, f: CompanyFilter = CompanyFilter(has_mobile=1), box=None,
    require_geo: bool = True, text: str = "", limit: int = 200,
) -> dict[str, DataFrame]:
    """Companies behind a cluster; a box or a region is required."""
    if box is None and not (f.city or f.district or f.street or f.street_empty):
        raise ValueError("a map box or a region is required")
    found = select_companies(tables, f, text)
    if box is not None or require_geo:
        found = pred.located(found, box)
    order = [F.desc_nulls_last("has_mobile"), F.desc_nulls_last("capital_wan"), F.asc(CODE)]
    have = set(found.columns)
    top = found.orderBy(*order).limit(limit).select(*[c for c in MAP_CARD if c in have])
    return {
        "items": agg.contact_preview(top, tables.contacts),
        "total": found.agg(F.count(F.lit(1)).alias("total")),
    }


def export(tables: Tables, f: CompanyFilter = CompanyFilter(), text: str = "", dimensions: str = "", limit: int | None = None) -> DataFrame:
    return export_rows(select_companies(tables, f, text, dimensions), tables.contacts, limit)


def company_detail(tables: Tables, code: str, user: str = "default") -> dict[str, DataFrame]:
    """Everything known about one company; key filters reach every scan."""
    own = F.col(CODE) == code
    contacts = tables.contacts.filter(own).orderBy("contact_type", F.desc("is_primary"), "contact_value")
    status = tables.contact_status.filter(own & (F.col("user_id") == user))
    return {
        "company": tables.companies.filter(own), "contacts": contacts,
        "tags": tables.tags.filter(own), "contact_status": status,
    }


def detail_batch(tables: Tables, user: str) -> DataFrame:
    """Contact, tag and status figures of all companies in one table."""
    counts = tables.contacts.groupBy(CODE).agg(
        F.count(F.lit(1)).alias("contacts"), F.sum("is_primary").alias("primary_contacts")
    )
    tagged = tables.tags.select(CODE, F.size("chain_industries").alias("chains"), "tag_fit")
    state = tables.contact_status.filter(F.col("user_id") == user).select(
        CODE, F.col("status").alias("contact_status")
    )
    joined = tables.companies.join(counts, CODE, "left").join(tagged, CODE, "left").join(state, CODE, "left")
    return joined.fillna(0, subset=["contacts", "primary_contacts"])


def reverse_lookup(tables: Tables, numbers: DataFrame) -> DataFrame:
    """(contact_value, credit_code, company_name) of contact values to look up."""
    wanted = numbers.select("contact_value").distinct()
    hits = tables.contacts.join(wanted, "contact_value", "left_semi")
    pairs = hits.select("contact_value", CODE).distinct()
    return pairs.join(tables.companies.select(CODE, "company_name"), CODE)


def with_certificate(tables: Tables, f: CompanyFilter, as_of=None) -> DataFrame:
    """Companies of the filter that hold a valid certificate."""
    holders = agg.valid_certificates(tables.qualifications, as_of).select(CODE).distinct()
    return select_companies(tables, f).join(holders, CODE, "left_semi")


# --- sales territory --------------------------------------------------------------------

LEVELS = ("province", "city", "district", "street")


def _rule_key(columns, mask: int):
    """Key of one combination of restricted levels: the mask and their names."""
    used = [c for i, c in enumerate(columns) if mask >> i & 1]
    return F.concat_ws("\x1f", F.lit(str(mask)), *used)


def in_territory(companies: DataFrame, rules: DataFrame) -> DataFrame:
    """Companies that meet at least one rule; '' in a rule matches everything.

    Each company has one key per combination of levels, each rule one key for
    the levels it restricts; they meet by equality. Without rules (or with a
    rule that restricts nothing) the caller gets every company.
    """
    restricted = [F.col(c) != "" for c in LEVELS]
    mask = sum((F.when(r, 1 << i).otherwise(0) for i, r in enumerate(restricted)), F.lit(0))
    given = [F.when(F.col(c) != "", F.col(c)) for c in LEVELS]
    rule_keys = rules.select(
        mask.alias("mask"), F.concat_ws("\x1f", mask.cast("string"), *given).alias("rule_key")
    ).filter(F.col("mask") > 0).distinct()
    keys = F.array(*[_rule_key([F.col(c) for c in LEVELS], m) for m in range(1, 1 << len(LEVELS))])
    keyed = companies.select(CODE, F.explode(keys).alias("rule_key"))
    matched = keyed.join(rule_keys.select("rule_key"), "rule_key", "left_semi").select(CODE).distinct()
    return companies.join(matched, CODE, "left_semi")


def task_pack(
    tables: Tables, user: str, age: tuple[float, float] = (1, 8), status: str = "存续",
    has_mobile: int = 1, limit: int = 50,
) -> DataFrame:
    """Today's calls of a user: own territory, reachable, young, not yet contacted."""
    f = CompanyFilter(status=status, has_mobile=has_mobile, age=age)
    due = tables.companies.filter(pred.company_predicate(f))
    due = pred.without_status(due, tables.contact_status, user, ("blocked", "contacted"))
    rules = tables.territory.filter(F.col("user_id") == user)
    restricting = rules.filter(F.concat(*[F.coalesce(c, F.lit("")) for c in LEVELS]) != "")
    if not restricting.isEmpty():
        due = in_territory(due, restricting)
    order = [F.desc_nulls_last("insured_count"), F.desc_nulls_last("capital_wan"), F.asc(CODE)]
    return due.orderBy(*order).limit(limit)

