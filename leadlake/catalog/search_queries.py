"""Search, statistics, facets, regions, detail, export, certificates and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.catalog import domain as d
from leadlake.catalog import vocabulary as v
from leadlake.catalog.domain_sql import words
from leadlake.catalog.entry import query
from leadlake.fixed_values import CITY_CENTRES, INDUSTRY_SECTIONS, PROVINCE_CENTRES, PROVINCES
from leadlake.functions.geo import region_centre
from leadlake.operators import aggregates as agg
from leadlake.operators import predicates as pred
from leadlake.operators.divisions import street_top, streets_with_counts
from leadlake.operators.predicates import CompanyFilter
from leadlake.operators.ranking import after_key, top_per_key
from leadlake.plans import search
from leadlake.schemas import Tables
from leadlake.sources.exports import export_table, seed_sample

PREVIEW = """
    previews AS (SELECT credit_code, string_agg(contact_type || ':' || contact_value, '|' ORDER BY is_primary DESC, contact_type, contact_value) AS preview
                 FROM (SELECT *, row_number() OVER (PARTITION BY credit_code ORDER BY is_primary DESC, contact_type, contact_value) AS rn
                       FROM contacts WHERE contact_type IN ('mobile', 'landline')) AS x WHERE rn <= 3 GROUP BY credit_code)"""


def previewed(items):
    shown = F.transform("contacts_preview", lambda x: F.concat_ws(":", x["contact_type"], x["contact_value"]))
    return F.array_join(shown, "|").alias("preview")


@query(
    "search_page",
    f"""
    WITH {PREVIEW}
    SELECT c.credit_code, company_name, legal_person, CAST(capital_wan AS DOUBLE) AS capital_wan, province, city,
           mobile_count, coalesce(preview, '') AS preview
    FROM (SELECT * FROM companies WHERE status = '存续' AND has_mobile = 1 AND company_age <= 20 AND insured_count >= 3
          ORDER BY capital_wan DESC NULLS LAST, credit_code LIMIT 50) AS c
         LEFT JOIN previews AS p ON c.credit_code = p.credit_code""",
    ("companies", "contacts"),
)
def search_page(spark, sf_dir):
    f = CompanyFilter(has_mobile=1, age=(None, 20), insured=(3, None))
    tables = Tables(d.companies(spark, sf_dir), d.contacts(spark, sf_dir))
    items = search.search(tables, f, number=1, size=50)["items"]
    return items.select(
        "credit_code", "company_name", "legal_person", "capital_wan", "province", "city",
        "mobile_count", previewed(items),
    )


@query(
    "search_name",
    f"""
    WITH {PREVIEW}
    SELECT c.credit_code, c.company_name, coalesce(preview, '') AS preview
    FROM (SELECT * FROM companies WHERE contains(company_name, '东方00000') AND status = '存续'
          ORDER BY CASE WHEN starts_with(company_name, '东方00000') THEN 0 ELSE 1 END, length(company_name),
                   established ASC NULLS LAST, credit_code LIMIT 200) AS c
         LEFT JOIN previews AS p ON c.credit_code = p.credit_code""",
    ("companies", "contacts"),
)
def search_name(spark, sf_dir):
    tables = Tables(d.companies(spark, sf_dir), d.contacts(spark, sf_dir))
    found = search.search(tables, text="东方00000", size=200, sort="established", descending=False)["items"]
    return found.select("credit_code", "company_name", previewed(found))


@query(
    "search_contact",
    """
    SELECT c.credit_code, c.company_name FROM companies AS c
    WHERE c.status IN ('存续', '注销') AND EXISTS (SELECT 1 FROM contacts AS t WHERE t.credit_code = c.credit_code
          AND t.contact_value = (SELECT '1' || CAST(3 + max(o_orderkey) % 7 AS VARCHAR) || lpad(CAST(max(o_orderkey) AS VARCHAR), 9, '0')
                                 FROM orders WHERE o_custkey % 4 <> 0 AND o_orderkey % 5 < 3))""",
    ("companies", "contacts"),
)
def search_contact(spark, sf_dir):
    """Company behind the newest mobile; the number is looked up first."""
    newest = d.contacts(spark, sf_dir).filter(F.col("contact_type") == "mobile").agg(
        F.max(F.struct(F.substring("contact_value", 3, 9), "contact_value"))["contact_value"]
    )
    number = newest.first()[0]
    tables = Tables(d.companies(spark, sf_dir), d.contacts(spark, sf_dir))
    found = pred.select_companies(tables, CompanyFilter(status="存续,注销"), f"+86 {number[:3]}-{number[3:]}")
    return found.select("credit_code", "company_name")


@query(
    "search_multi_or",
    """
    SELECT c.credit_code, c.company_name, c.legal_person FROM companies AS c
    WHERE c.legal_person = '王伟' OR contains(c.company_name, '王伟')
       OR (list_contains(string_split(c.address, ''), '王') AND contains(c.address, '王伟'))""",
    ("companies",),
)
def search_multi_or(spark, sf_dir):
    tables = Tables(d.companies(spark, sf_dir), d.contacts(spark, sf_dir))
    found = pred.select_companies(
        tables, CompanyFilter(status=""), "王伟", "company,person,mobile，email,address,credit"
    )
    return found.select("credit_code", "company_name", "legal_person")


@query(
    "search_or_exists",
    """
    SELECT c.credit_code, c.legal_person, c.scope FROM companies AS c
    WHERE contains(c.company_name, 'user1009@mail9.com') OR EXISTS (
          SELECT 1 FROM contacts AS t WHERE t.credit_code = c.credit_code AND t.contact_type = 'email' AND lower(t.contact_value) = 'user1009@mail9.com')""",
    ("companies", "contacts"),
)
def search_or_exists(spark, sf_dir):
    tables = Tables(d.companies(spark, sf_dir), d.contacts(spark, sf_dir))
    found = pred.select_companies(tables, CompanyFilter(status=""), "User1009@Mail9.com", "company,email")
    return found.select("credit_code", "legal_person", "scope")


@query(
    "search_keyword",
    """
    SELECT credit_code, scope, city FROM companies
    WHERE (contains(scope, '智') OR contains(scope, '能') OR contains(lower(scope), 'cloud')) AND contains(address, '南')
      AND (coalesce(street, '') = '')""",
    ("companies",),
)
def search_keyword(spark, sf_dir):
    f = CompanyFilter(status="", scope_words="智能 CLOUD", address_words="南", street_empty=True)
    found = pred.select_companies(Tables(d.companies(spark, sf_dir)), f)
    return found.select("credit_code", "scope", "city")


@query(
    "search_tags",
    """
    SELECT c.credit_code, c.company_name, c.scale FROM companies AS c JOIN tags AS t ON c.credit_code = t.credit_code
    WHERE t.tag_fit = '数据智能' AND contains(array_to_string(t.chain_industries, ' | '), '云计算')
      AND c.established_year BETWEEN 2005 AND 2020 AND c.has_email = 1""",
    ("companies", "tags"),
)
def search_tags(spark, sf_dir):
    f = CompanyFilter(
        status="", tag_fit="数据智能", chain="云计算", established_year=(2005, 2020), has_email=1, has_mobile=-1
    )
    tables = Tables(d.companies(spark, sf_dir), tags=d.tags(spark, sf_dir))
    return pred.select_companies(tables, f).select("credit_code", "company_name", "scale")


@query(
    "exclude_blocked",
    """
    SELECT c.credit_code, c.status FROM companies AS c
    WHERE c.industry_l1 = '制造业' AND NOT EXISTS (SELECT 1 FROM contact_status AS s
          WHERE s.credit_code = c.credit_code AND s.user_id = 'u1' AND s.status = 'blocked')""",
    ("companies", "contact_status"),
)
def exclude_blocked(spark, sf_dir):
    tables = Tables(d.companies(spark, sf_dir), contact_status=d.contact_status(spark, sf_dir))
    f = CompanyFilter(status="", industry_l1="制造业", not_blocked_by="u1")
    return pred.select_companies(tables, f).select("credit_code", "status")


@query(
    "phone_lookup",
    """
    SELECT DISTINCT t.contact_value, c.credit_code, c.company_name FROM contacts AS t JOIN companies AS c ON t.credit_code = c.credit_code
    WHERE t.contact_value IN (SELECT '010-' || lpad(CAST(event_id AS VARCHAR), 8, '0') FROM events)""",
    ("contacts", "companies"),
)
def phone_lookup(spark, sf_dir):
    numbers = d.table(spark, sf_dir, "events").select(
        F.concat(F.lit("010-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("contact_value")
    )
    return search.reverse_lookup(Tables(d.companies(spark, sf_dir), d.contacts(spark, sf_dir)), numbers)


@query(
    "keyset_page",
    "SELECT credit_code, company_name FROM companies WHERE credit_code > '9100000000' ORDER BY credit_code LIMIT 100",
    ("companies",),
)
def keyset_page(spark, sf_dir):
    return after_key(
        d.companies(spark, sf_dir).select("credit_code", "company_name"), "credit_code", "9100000000", 100
    )


@query(
    "stats_summary",
    """
    SELECT count(*) AS total, sum(has_mobile) AS with_mobile, sum(has_landline) AS with_landline, sum(has_email) AS with_email,
           sum(has_contact) AS with_contact, round(CAST(sum(capital_wan) AS DOUBLE) / count(capital_wan), 3) AS avg_capital,
           round(avg(insured_count), 6) AS avg_insured
    FROM companies WHERE status = '存续'""",
    ("companies",),
)
def stats_summary(spark, sf_dir):
    stats = search.statistics(Tables(d.companies(spark, sf_dir)))["summary"]
    return stats.withColumns(
        {"avg_capital": F.round(F.col("avg_capital").cast("double"), 3), "avg_insured": F.round("avg_insured", 6)}
    )


@query(
    "stats_contact_search",
    """
    SELECT count(*) AS total, sum(has_email) AS with_email, sum(insured_count) AS insured FROM companies AS c
    WHERE status = '存续' AND EXISTS (SELECT 1 FROM contacts AS t WHERE t.credit_code = c.credit_code
          AND ((t.contact_type = 'mobile' AND t.contact_value = '13000000000') OR t.contact_value = 'user4@mail4.com'))""",
    ("companies", "contacts"),
)
def stats_contact_search(spark, sf_dir):
    """Two contact searches united; every company counts once."""
    tables = Tables(d.companies(spark, sf_dir), d.contacts(spark, sf_dir))
    phone = pred.select_companies(tables, CompanyFilter(), "13000000000", "mobile")
    mail = pred.select_companies(tables, CompanyFilter(), "user4@mail4.com", "email")
    found = phone.unionByName(mail).dropDuplicates(["credit_code"])
    return found.agg(
        F.count(F.lit(1)).alias("total"), F.sum("has_email").alias("with_email"), F.sum("insured_count").alias("insured")
    )


@query(
    "top_province",
    "SELECT province AS k, count(*) AS n FROM companies WHERE status = '存续' AND province <> '' GROUP BY province ORDER BY n DESC, k LIMIT 12",
    ("companies",),
)
def top_province(spark, sf_dir):
    return search.statistics(Tables(d.companies(spark, sf_dir)))["by_province"]


@query(
    "top_industry",
    "SELECT industry_l1 AS k, count(*) AS n FROM companies WHERE status = '存续' GROUP BY industry_l1 ORDER BY n DESC, k LIMIT 12",
    ("companies",),
)
def top_industry(spark, sf_dir):
    return search.statistics(Tables(d.companies(spark, sf_dir)))["by_industry"]


@query(
    "facets",
    f"""
    SELECT 'province' AS dim, province AS k, count(*) AS n FROM companies WHERE list_contains({words(PROVINCES)}, province) GROUP BY province
    UNION ALL SELECT 'industry', industry_l1, count(*) FROM companies WHERE list_contains({words(INDUSTRY_SECTIONS)}, industry_l1) GROUP BY industry_l1
    UNION ALL SELECT 'scale', scale, count(*) FROM companies WHERE scale IS NOT NULL GROUP BY scale
    UNION ALL SELECT 'status', status, count(*) FROM companies WHERE status IS NOT NULL GROUP BY status""",
    ("companies",),
)
def facets(spark, sf_dir):
    return agg.company_facets(d.companies(spark, sf_dir))


@query(
    "chain_facet",
    """
    SELECT trim(x) AS k, count(*) AS n
    FROM (SELECT unnest(string_split(array_to_string(chain_industries, ' | '), ' | ')) AS x FROM tags) AS u
    GROUP BY trim(x) ORDER BY n DESC, k LIMIT 80""",
    ("tags",),
)
def chain_facet(spark, sf_dir):
    return agg.chain_facet(d.tags(spark, sf_dir))


@query(
    "region_cascade",
    """
    SELECT 'city' AS level, * FROM (SELECT city AS k, count(*) AS n FROM companies WHERE province = '浙江省' GROUP BY city) AS a
    UNION ALL SELECT 'core', * FROM (SELECT city AS k, count(*) AS n FROM companies WHERE province IN ('江苏省', '浙江省', '上海市', '安徽省') GROUP BY city) AS b
    UNION ALL SELECT 'district', * FROM (SELECT district AS k, count(*) AS n FROM companies WHERE province = '浙江省' AND city = '杭州市' GROUP BY district) AS c""",
    ("companies",),
)
def region_cascade(spark, sf_dir):
    tables = Tables(d.companies(spark, sf_dir))
    parts = {
        "city": search.cities(tables, "浙江省"), "core": search.cities(tables),
        "district": search.districts(tables, "浙江省", "杭州市"),
    }
    rows = [p.select(F.lit(level).alias("level"), "k", "n") for level, p in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "streets_with_counts",
    f"""
    WITH counts AS (SELECT province, city, district, street AS k, count(*) AS n FROM companies WHERE coalesce(street, '') <> '' GROUP BY ALL),
         places AS (SELECT DISTINCT province, city, district FROM companies),
         listed AS (SELECT DISTINCT p.province, p.city, p.district, v.street AS k FROM places AS p JOIN divisions AS v ON v.level = 'street' AND v.district = p.district
                    AND v.city = CASE WHEN p.city LIKE '%直辖%' THEN p.district ELSE ({words(v.TREE_CITIES)})[list_position({words(v.CITIES)}, p.city)] END)
    SELECT l.province, l.city, l.district, l.k, coalesce(c.n, 0) AS n FROM listed AS l
    LEFT JOIN counts AS c ON c.province = l.province AND c.city = l.city AND c.district = l.district AND c.k = l.k
    UNION ALL
    SELECT c.province, c.city, c.district, c.k, c.n FROM counts AS c
    WHERE NOT EXISTS (SELECT 1 FROM listed AS l WHERE l.province = c.province AND l.city = c.city AND l.district = c.district)""",
    ("companies", "divisions"),
)
def streets_with_counts_query(spark, sf_dir):
    return streets_with_counts(d.companies(spark, sf_dir), d.divisions(spark, sf_dir))


@query(
    "cert_timeline",
    """
    SELECT credit_code, count(*) AS certs, sum(revoked) AS revoked_n FROM qualifications
    GROUP BY credit_code HAVING sum(revoked) > 0 ORDER BY certs DESC, credit_code LIMIT 30""",
    ("qualifications",),
)
def cert_timeline(spark, sf_dir):
    return agg.revoked_timeline(d.qualifications(spark, sf_dir), 30)


@query(
    "qualified_filter",
    """
    SELECT c.credit_code, c.company_name, c.city FROM companies AS c
    WHERE c.province = '浙江省' AND c.has_mobile = 1 AND c.status = '存续'
      AND EXISTS (SELECT 1 FROM qualifications AS q WHERE q.credit_code = c.credit_code AND q.revoked = 0 AND q.valid_to >= DATE '2001-01-01')""",
    ("companies", "qualifications"),
)
def qualified_filter(spark, sf_dir):
    tables = Tables(d.companies(spark, sf_dir), qualifications=d.qualifications(spark, sf_dir))
    f = CompanyFilter(province="浙江省", has_mobile=1)
    found = search.with_certificate(tables, f, F.lit("2001-01-01").cast("date"))
    return found.select("credit_code", "company_name", "city")


@query(
    "certified_coverage",
    """
    SELECT count(DISTINCT q.credit_code) AS certified, count(DISTINCT c.credit_code) AS in_registry
    FROM qualifications AS q LEFT JOIN tags AS c ON q.credit_code = c.credit_code WHERE q.revoked = 0""",
    ("qualifications", "tags"),
)
def certified_coverage(spark, sf_dir):
    return agg.certified_coverage(d.tags(spark, sf_dir), d.qualifications(spark, sf_dir))


@query(
    "task_pack",
    """
    SELECT c.credit_code, c.province, c.city, c.street, c.insured_count FROM companies AS c
    WHERE c.status = '存续' AND c.has_mobile = 1 AND c.company_age BETWEEN 1 AND 8
      AND EXISTS (SELECT 1 FROM territory AS t WHERE t.user_id = 'u0' AND (t.province = '' OR t.province = c.province)
                  AND (t.city = '' OR t.city = c.city) AND (t.district = '' OR t.district = c.district) AND (t.street = '' OR t.street = c.street))
      AND NOT EXISTS (SELECT 1 FROM contact_status AS s WHERE s.credit_code = c.credit_code AND s.user_id = 'u0' AND s.status IN ('blocked', 'contacted'))
    ORDER BY c.insured_count DESC, c.capital_wan DESC NULLS LAST, c.credit_code LIMIT 200""",
    ("companies", "territory", "contact_status"),
)
def task_pack(spark, sf_dir):
    packed = search.task_pack(d.tables(spark, sf_dir), "u0", limit=200)
    return packed.select("credit_code", "province", "city", "street", "insured_count")


@query(
    "territory_join",
    """
    SELECT c.credit_code, c.province, c.city FROM companies AS c
    WHERE EXISTS (SELECT 1 FROM territory AS t WHERE t.user_id = 'u2' AND (t.province = '' OR t.province = c.province)
                  AND (t.city = '' OR t.city = c.city) AND (t.district = '' OR t.district = c.district) AND (t.street = '' OR t.street = c.street))""",
    ("companies", "territory"),
)
def territory_join(spark, sf_dir):
    rules = d.territory(spark, sf_dir).filter(F.col("user_id") == "u2")
    return search.in_territory(d.companies(spark, sf_dir), rules).select("credit_code", "province", "city")


@query(
    "company_detail",
    """
    SELECT c.credit_code, c.company_name, coalesce(n, 0) AS contacts, coalesce(p, 0) AS primary_contacts, len(t.chain_industries) AS chains,
           t.tag_fit, s.status AS contact_status
    FROM companies AS c LEFT JOIN (SELECT credit_code, count(*) AS n, sum(is_primary) AS p FROM contacts GROUP BY credit_code) AS k ON k.credit_code = c.credit_code
         LEFT JOIN tags AS t ON t.credit_code = c.credit_code
         LEFT JOIN contact_status AS s ON s.credit_code = c.credit_code AND s.user_id = 'u1'""",
    ("companies", "contacts", "tags", "contact_status"),
)
def company_detail(spark, sf_dir):
    batch = search.detail_batch(d.tables(spark, sf_dir), "u1")
    return batch.select(
        "credit_code", "company_name", "contacts", "primary_contacts", "chains", "tag_fit", "contact_status"
    )


@query(
    "contact_preview",
    f"""
    WITH {PREVIEW}
    SELECT c.credit_code, coalesce(preview, '') AS preview FROM companies AS c LEFT JOIN previews AS p ON c.credit_code = p.credit_code""",
    ("companies", "contacts"),
)
def contact_preview(spark, sf_dir):
    shown = agg.contact_preview(d.companies(spark, sf_dir).select("credit_code"), d.contacts(spark, sf_dir))
    return shown.select("credit_code", previewed(shown))


PIVOT = """
    pivoted AS (SELECT credit_code,
        coalesce(string_agg(contact_value, ';' ORDER BY is_primary DESC, contact_value) FILTER (WHERE contact_type = 'mobile'), '') AS mobiles,
        coalesce(string_agg(contact_value, ';' ORDER BY is_primary DESC, contact_value) FILTER (WHERE contact_type = 'landline'), '') AS landlines,
        coalesce(string_agg(contact_value, ';' ORDER BY is_primary DESC, contact_value) FILTER (WHERE contact_type = 'email'), '') AS emails
        FROM contacts GROUP BY credit_code)"""


@query(
    "contact_pivot",
    f"WITH {PIVOT} SELECT credit_code, 1 AS part, mobiles, landlines, emails FROM pivoted",
    ("contacts",),
)
def contact_pivot(spark, sf_dir):
    return agg.contact_lists(d.contacts(spark, sf_dir))


@query(
    "contact_pivot_parts",
    """
    SELECT credit_code, part, coalesce(max(cell) FILTER (WHERE contact_type = 'mobile'), '') AS mobiles,
           coalesce(max(cell) FILTER (WHERE contact_type = 'landline'), '') AS landlines, coalesce(max(cell) FILTER (WHERE contact_type = 'email'), '') AS emails
    FROM (SELECT credit_code, contact_type, (rn - 1) // 3 + 1 AS part, string_agg(contact_value, ';' ORDER BY rn) AS cell
          FROM (SELECT *, row_number() OVER (PARTITION BY credit_code, contact_type ORDER BY is_primary DESC, contact_value) AS rn FROM contacts) AS x
          GROUP BY ALL) AS y
    GROUP BY credit_code, part""",
    ("contacts",),
)
def contact_pivot_parts(spark, sf_dir):
    """The same lists cut into cells of three, as a very large company would be."""
    return agg.contact_lists(d.contacts(spark, sf_dir), cell_values=3)


@query(
    "export_wide",
    f"""
    WITH {PIVOT},
    best AS (SELECT * FROM companies WHERE status = '存续')
    SELECT b.credit_code AS "统一社会信用代码", company_name AS "企业名称", coalesce(CAST(capital_wan AS VARCHAR), '') AS "注册资本(万元)",
           CAST(established AS VARCHAR) AS "成立日期", coalesce(street, '') AS "街道", coalesce(mobiles, '') AS "手机", coalesce(landlines, '') AS "座机",
           coalesce(emails, '') AS "邮箱", CAST(has_mobile AS VARCHAR) AS "有手机", '' AS "实缴资本(万元)", '1' AS "续行"
    FROM best AS b LEFT JOIN pivoted AS p ON b.credit_code = p.credit_code""",
    ("companies", "contacts"),
)
def export_wide(spark, sf_dir):
    rows = search.export(Tables(d.companies(spark, sf_dir), d.contacts(spark, sf_dir)))
    labelled = export_table(rows)
    return labelled.select(
        "统一社会信用代码", "企业名称", "`注册资本(万元)`", "成立日期", "街道", "手机", "座机", "邮箱", "有手机",
        "`实缴资本(万元)`", "续行",
    )


@query(
    "sample_seed",
    """
    WITH a AS (SELECT * FROM companies WHERE coalesce(intro, '') = '' AND status = '存续' AND credit_code LIKE '9%' AND credit_code LIKE '%1' ORDER BY credit_code LIMIT 1200),
         b AS (SELECT * FROM companies WHERE intro <> '' AND credit_code IN (SELECT credit_code FROM tags) ORDER BY credit_code LIMIT 300),
         s AS (SELECT credit_code FROM a UNION SELECT credit_code FROM b)
    SELECT 'companies' AS name, count(*) AS n FROM s
    UNION ALL SELECT 'contacts', count(*) FROM contacts WHERE credit_code IN (SELECT credit_code FROM s)
    UNION ALL SELECT 'tags', count(*) FROM tags WHERE credit_code IN (SELECT credit_code FROM s)""",
    ("companies", "contacts", "tags"),
)
def sample_seed(spark, sf_dir):
    """The published sampling rules: sparse companies, and rich ones with tags."""
    tags = d.tags(spark, sf_dir)
    tagged = pred.tagged_codes(tags, "", "").select("credit_code", F.lit(True).alias("tagged"))
    c = d.companies(spark, sf_dir).join(tagged, "credit_code", "left")
    no_intro = F.coalesce(F.col("intro"), F.lit("")) == ""
    code = F.col("credit_code")
    rules = [
        ([no_intro, F.col("status") == "存续", code.startswith("9"), code.endswith("1")], 1200),
        ([~no_intro, F.col("tagged")], 300),
    ]
    sample = seed_sample(c, rules, {"contacts": d.contacts(spark, sf_dir), "tags": tags})
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, t in sample.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "reach_rates",
    """
    SELECT province, count(*) AS n, round(sum(has_mobile) * 100 / count(*), 2) AS mobile_pct, round(sum(has_landline) * 100 / count(*), 2) AS landline_pct,
           round(sum(has_email) * 100 / count(*), 2) AS email_pct, round(sum(has_contact) * 100 / count(*), 2) AS any_pct
    FROM companies GROUP BY province""",
    ("companies",),
)
def reach_rates(spark, sf_dir):
    return agg.reach_rates(d.companies(spark, sf_dir), ["province"])


@query(
    "capital_magnitudes",
    """
    SELECT count(*) FILTER (WHERE capital_wan >= 100000000) AS ge_1e8, count(*) FILTER (WHERE capital_wan >= 10000000 AND capital_wan < 100000000) AS ge_1e7,
           count(*) FILTER (WHERE capital_wan >= 1000000 AND capital_wan < 10000000) AS ge_1e6 FROM companies""",
    ("companies",),
)
def capital_magnitudes(spark, sf_dir):
    return agg.capital_magnitudes(d.companies(spark, sf_dir))


@query(
    "health_counts",
    """
    SELECT count(*) AS companies, count(lng) AS geocoded, count(*) FILTER (WHERE street <> '') AS with_street,
           count(*) FILTER (WHERE lng IS NULL AND status = '存续') AS to_locate,
           count(*) FILTER (WHERE lng IS NULL AND status = '存续' AND street <> '') AS to_locate_with_street FROM companies""",
    ("companies",),
)
def health_counts(spark, sf_dir):
    return agg.health(d.companies(spark, sf_dir))


@query(
    "sparse_rich",
    """
    SELECT count(*) FILTER (WHERE coalesce(intro, '') = '' AND credit_code NOT IN (SELECT credit_code FROM tags)) AS sparse,
           count(*) FILTER (WHERE intro <> '' AND credit_code IN (SELECT credit_code FROM tags)) AS rich FROM companies""",
    ("companies", "tags"),
)
def sparse_rich(spark, sf_dir):
    return agg.sparse_and_rich(d.companies(spark, sf_dir), d.tags(spark, sf_dir))


@query(
    "person_names",
    "SELECT legal_person AS k, count(*) AS n FROM companies WHERE legal_person LIKE '王%' GROUP BY legal_person ORDER BY n DESC, k LIMIT 10",
    ("companies",),
)
def person_names(spark, sf_dir):
    return agg.person_names(d.companies(spark, sf_dir), "王")


@query(
    "top_capital",
    "SELECT company_name, CAST(capital_wan AS DOUBLE) AS capital_wan FROM companies WHERE capital_wan IS NOT NULL ORDER BY capital_wan DESC, credit_code LIMIT 10",
    ("companies",),
)
def top_capital(spark, sf_dir):
    c = d.companies(spark, sf_dir).filter(F.col("capital_wan").isNotNull())
    return c.orderBy(F.desc("capital_wan"), "credit_code").limit(10).select("company_name", "capital_wan")


@query(
    "top_contacts",
    """
    SELECT credit_code, contact_value, is_primary FROM (SELECT *, row_number() OVER (PARTITION BY credit_code ORDER BY is_primary DESC, contact_type, contact_value) AS rn FROM contacts) AS x
    WHERE rn <= 3""",
    ("contacts",),
)
def top_contacts(spark, sf_dir):
    order = [F.desc("is_primary"), F.asc("contact_type"), F.asc("contact_value")]
    top = top_per_key(d.contacts(spark, sf_dir), ["credit_code"], order, 3)
    return top.select("credit_code", "contact_value", "is_primary")


@query(
    "name_sample",
    """
    SELECT credit_code, company_name FROM companies
    WHERE length(company_name) BETWEEN 14 AND 16 AND company_name NOT LIKE '%贸易%' AND regexp_matches(company_name, '^(恒信|华美)')""",
    ("companies",),
)
def name_sample(spark, sf_dir):
    found = pred.name_sample(d.companies(spark, sf_dir), 14, 16, "%贸易%", "^(恒信|华美)")
    return found.select("credit_code", "company_name")


@query(
    "contact_types",
    "SELECT contact_type AS k, count(*) AS n FROM contacts GROUP BY contact_type",
    ("contacts",),
)
def contact_types(spark, sf_dir):
    return agg.value_counts(d.contacts(spark, sf_dir), "contact_type")


@query(
    "street_top",
    "SELECT street AS k, count(*) AS n FROM companies WHERE street <> '' GROUP BY street ORDER BY n DESC, k LIMIT 15",
    ("companies",),
)
def street_top_query(spark, sf_dir):
    return street_top(d.companies(spark, sf_dir))


@query(
    "tagged_codes",
    "SELECT credit_code, tag_fit FROM tags WHERE len(chain_industries) > 0 AND credit_code LIKE '9%' AND credit_code LIKE '%0'",
    ("tags",),
)
def tagged_codes(spark, sf_dir):
    return pred.tagged_codes(d.tags(spark, sf_dir), "9", "0").select("credit_code", "tag_fit")


def _values(points):
    return ", ".join(f"('{k}', CAST({p[0]} AS DOUBLE), CAST({p[1]} AS DOUBLE))" for k, p in points.items())


@query(
    "region_centres",
    f"""
    WITH cities(city, lat, lng) AS (VALUES {_values(CITY_CENTRES)}), provinces(province, lat, lng) AS (VALUES {_values(PROVINCE_CENTRES)})
    SELECT c.credit_code, coalesce(x.lat, p.lat) AS lat, coalesce(x.lng, p.lng) AS lng
    FROM companies AS c LEFT JOIN cities AS x ON x.city = c.city LEFT JOIN provinces AS p ON p.province = c.province""",
    ("companies",),
)
def region_centres(spark, sf_dir):
    centre = region_centre(F.col("city"), F.col("province"))
    return d.companies(spark, sf_dir).select("credit_code", centre.alias("p")).select("credit_code", "p.*")
