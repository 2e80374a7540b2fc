"""Cleaning rules over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.catalog import vocabulary as v
from leadlake.catalog.domain import as_of, capital_text, company_name, pick, registry_rows, table
from leadlake.catalog.domain_sql import A, K, N, capital_currency, capital_text as capital_text_sql
from leadlake.catalog.domain_sql import capital_wan, code, name, pick as pick_sql
from leadlake.catalog.entry import query
from leadlake.fixed_values import EMAIL_ANYWHERE
from leadlake.functions import capital, contacts, dates, geo, identity, region, street, tags, text


@query(
    "clean_sentinels",
    f"""
    SELECT lang AS k, count(*) AS n, count(value) AS kept, min(value) AS first_value
    FROM (SELECT lang, CASE doc_id % 8 WHEN 7 THEN '值' END AS value FROM documents
          UNION ALL
          SELECT lang, trim(regexp_replace(source, 'x^', '')) FROM documents) AS x
    GROUP BY lang""",
)
def clean_sentinels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    spelled = docs.select("lang", pick(v.EMPTY_SPELLINGS, F.col("doc_id") % 8).alias("raw"))
    padded = docs.select("lang", F.concat(F.lit(" 　"), "source", F.lit("\t ")).alias("raw"))
    cleaned = spelled.unionByName(padded).withColumn("value", text.clean(F.col("raw")))
    return cleaned.groupBy(F.col("lang").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("kept"), F.min("value").alias("first_value")
    )


@query(
    "byte_truncate",
    f"""
    SELECT c_custkey AS k, left(nm, (SELECT max(i) FROM range(0, 41) AS r(i)
                                     WHERE strlen(left(nm, i)) <= 20 + c_custkey % 20)) AS cut
    FROM (SELECT c_custkey, {name(K)} || c_mktsegment AS nm FROM customer) AS x""",
)
def byte_truncate(spark, sf_dir):
    k = F.col("c_custkey")
    long_name = F.concat(company_name(k), "c_mktsegment")
    return table(spark, sf_dir, "customer").select(k.alias("k"), long_name.alias("nm")).select(
        "k", _by_remainder(F.col("k"), F.col("nm")).alias("cut")
    )


def _by_remainder(k, c):
    cut = F.lit(None).cast("string")
    for limit in range(20, 40):
        cut = F.when(k % 20 == limit - 20, text.byte_truncate(c, limit)).otherwise(cut)
    return cut


@query(
    "split_multi",
    """
    SELECT p_partkey AS k,
           CASE WHEN p_name IN ('-', '') THEN '' ELSE p_brand || '|' || replace(p_name, ' ', '|') || '|' || p_type END AS parts
    FROM part""",
)
def split_multi(spark, sf_dir):
    cell = F.concat(F.lit("　"), "p_brand", F.lit("，；"), "p_name", F.lit("、-|"), "p_type", F.lit(" ; 无"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), text.split_multi(cell).alias("parts")
    )


@query(
    "parse_capital",
    f"""
    SELECT {K} AS k, {capital_text_sql(K, A)} AS raw, CAST({capital_wan(K, A)} AS DOUBLE) AS wan,
           {capital_currency(K)} AS currency
    FROM customer""",
)
def parse_capital(spark, sf_dir):
    k = F.col("c_custkey")
    raw = capital_text(k, F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), raw.alias("raw"), company_name(k).alias("name")
    ).select(
        "k", "raw", capital.capital_wan(F.col("raw"), F.col("name")).alias("wan"),
        capital.capital_currency(F.col("raw")).alias("currency"),
    )


@query(
    "parse_date",
    """
    SELECT o_orderkey AS k,
           CAST(CASE WHEN o_orderkey % 6 < 4 THEN CAST(o_orderdate AS DATE) END AS VARCHAR) AS day,
           CAST(CASE WHEN o_orderkey % 6 < 4 THEN round(date_diff('day', CAST(o_orderdate AS DATE), DATE '2026-01-01') / 365.25, 1) END AS DOUBLE) AS age
    FROM orders""",
)
def parse_date(spark, sf_dir):
    o, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    forms = [
        F.date_format(d, "yyyy/M/d"), F.date_format(d, "yyyy年M月d日"),
        F.concat(F.lit("  "), F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")),
        F.concat(F.lit("成立于"), F.date_format(d, "yyyy.MM.dd"), F.lit("。")),
        F.date_format(d, "yyyy-02-30"), F.lit("暂无"),
    ]
    raw = forms[-1]
    for i, form in enumerate(forms[:-1]):
        raw = F.when(o % 6 == i, form).otherwise(raw)
    days = table(spark, sf_dir, "orders").select(o.alias("k"), dates.parse_date(raw).alias("day"))
    return days.select("k", "day", dates.company_age(F.col("day"), as_of()).alias("age"))


@query(
    "contact_normalise",
    """
    SELECT row_no AS k, m1 || '|' || m2 AS mobiles, l1 AS landlines,
           e1 || CASE WHEN e2 IS NOT NULL AND e2 <> e1 THEN '|' || e2 ELSE '' END AS emails
    FROM registry_rows""",
    ("registry_rows",),
)
def contact_normalise(spark, sf_dir):
    return registry_rows(spark, sf_dir).select(
        F.col("row_no").alias("k"),
        contacts.mobiles(F.col("mobile"), F.col("landline")).alias("mobiles"),
        contacts.landlines(F.col("landline")).alias("landlines"),
        contacts.emails(F.col("email"), F.col("email2")).alias("emails"),
    )


@query(
    "mail_addresses",
    """
    SELECT c_custkey AS k, c_name || ' | ' || c_mktsegment AS addresses FROM customer""",
)
def mail_addresses(spark, sf_dir):
    cell = F.concat("c_name", F.lit("\t;\t"), "c_mktsegment", F.lit("\t-;"), "c_name", F.lit(" ;"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), contacts.mail_addresses(cell).alias("addresses")
    )


@query(
    "surrogate_key",
    f"SELECT {K} AS k, {code(K)} AS credit_code FROM customer",
)
def surrogate_key(spark, sf_dir):
    k = F.col("c_custkey")
    given = F.when(k % 9 == 0, F.lit("91-bad")).otherwise(
        F.concat(F.lit(" 91 "), F.lpad(k.cast("string"), 16, "0"))
    )
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), identity.entity_code(given, company_name(k)).alias("credit_code")
    )


@query(
    "region_normalise",
    f"""
    SELECT c_custkey AS k,
           CASE WHEN c_nationkey % 3 < 2 THEN {pick_sql(v.PROVINCES, N)}
                ELSE ['江苏省', '上海市', '广东省', '内蒙古自治区', NULL][c_custkey % 5 + 1] END AS province,
           {pick_sql(v.STATUS, f'{K} * 3 % 8')} AS status,
           ['江苏省', '上海市', '广东省', '内蒙古自治区', NULL][c_custkey % 5 + 1] AS folder_province
    FROM customer""",
)
def region_normalise(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    full = pick(v.PROVINCES, n)
    raw = F.when(n % 3 == 0, F.regexp_replace(full, "省$|市$|维吾尔自治区$", "")).when(n % 3 == 1, full).otherwise(" 无 ")
    folder = pick(v.FOLDERS, k % 5)
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), region.province(raw, folder).alias("province"),
        region.status(pick(v.STATUS_RAW, k * 3 % 8)).alias("status"),
        region.folder_province(folder).alias("folder_province"),
    )


@query(
    "region_parts",
    f"""
    SELECT s_suppkey AS k, {pick_sql(v.PROVINCES, 's_nationkey')} AS province,
           CASE WHEN s_nationkey IN (4, 6, 7, 8) THEN {pick_sql(v.PROVINCES, 's_nationkey')}
                WHEN s_suppkey % 3 > 0 THEN {pick_sql(v.CITIES, 's_nationkey')} END AS city,
           CASE WHEN s_nationkey IN (4, 6, 7, 8) OR s_suppkey % 3 > 1 THEN {pick_sql(v.DISTRICTS, 's_suppkey % 4')} END AS district
    FROM supplier""",
)
def region_parts(spark, sf_dir):
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    prov, city, dist = pick(v.PROVINCES, n), pick(v.CITIES, n), pick(v.DISTRICTS, k % 4)
    short = F.regexp_replace(prov, "省$|市$", "")
    municipal = n.isin(4, 6, 7, 8)
    raw = (
        F.when(municipal & (k % 2 == 0), F.concat_ws("-", short, dist))
        .when(municipal, F.concat_ws(" / ", short, prov, dist))
        .when(k % 3 == 0, short).when(k % 3 == 1, F.concat_ws("—", short, city))
        .otherwise(F.concat_ws("-", prov, city, dist))
    )
    return table(spark, sf_dir, "supplier").select(
        k.alias("k"), region.region_parts(raw).alias("r")
    ).select("k", "r.*")


@query(
    "city_alias_names",
    f"""
    SELECT c_custkey AS k,
           CASE WHEN c_nationkey IN {v.PLACEHOLDERS} THEN {pick_sql(v.COUNTY_CITIES, 'c_custkey % 4')} || '|' || {pick_sql(v.CITIES, N)}
                WHEN c_nationkey = 8 THEN '重庆市|重庆城区|重庆郊县'
                WHEN c_nationkey IN (4, 6, 7) THEN {pick_sql(v.CITIES, N)} || '|' || {pick_sql(v.TREE_CITIES, N)}
                WHEN c_nationkey IN (15, 20) THEN {pick_sql(v.TREE_CITIES, N)} || '|' || {pick_sql(v.CITIES, N)}
                ELSE {pick_sql(v.CITIES, N)} END AS names
    FROM customer""",
)
def city_alias_names(spark, sf_dir):
    from leadlake.catalog.domain import district

    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), region.city_names(pick(v.CITIES, n), district(k, n)).alias("names")
    )


@query(
    "fill_score",
    "SELECT row_no AS k, fill_score FROM registry_rows",
    ("registry_rows",),
)
def fill_score(spark, sf_dir):
    rows = registry_rows(spark, sf_dir)
    fields = [c for c in rows.columns if c not in ("src_group", "src_file", "row_no")]
    return rows.select(
        F.col("row_no").alias("k"), text.filled_count([F.col(c) for c in fields]).alias("fill_score")
    )


@query(
    "document_contacts",
    r"""
    WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')) AS e FROM documents),
         once AS (SELECT DISTINCT doc_id, lower(e) AS e FROM found)
    SELECT lang, (SELECT count(*) FROM once JOIN documents AS d USING (doc_id) WHERE d.lang = docs.lang) AS addresses,
           (SELECT count(*) FROM once JOIN documents AS d USING (doc_id) WHERE d.lang = docs.lang AND NOT contains(e, 'example.com')) AS kept
    FROM documents AS docs GROUP BY lang""",
)
def document_contacts(spark, sf_dir):
    """Distinct e-mail addresses per document, over whole texts; placeholder
    addresses at example.com are found but not kept."""
    docs = table(spark, sf_dir, "documents")
    everything = F.regexp_extract_all(F.lower("text"), F.lit(EMAIL_ANYWHERE), F.lit(0))
    return docs.groupBy("lang").agg(
        F.sum(F.size(F.array_distinct(everything))).alias("addresses"),
        F.sum(F.size(contacts.scoring_emails(F.col("text")))).alias("kept"),
    )


@query(
    "certificate_fields",
    """
    SELECT l_orderkey AS k, l_linenumber AS line, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS valid_to,
           CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 1 ELSE 0 END AS revoked,
           CASE WHEN l_linenumber % 2 = 0 THEN 'GR' || CAST(l_partkey AS VARCHAR)
                ELSE 'HT-' || CAST(year(l_shipdate) AS VARCHAR) || '-' || right(lpad(CAST(l_orderkey AS VARCHAR), 18, '9'), 8) END AS cert_no
    FROM lineitem""",
)
def certificate_fields(spark, sf_dir):
    d, line = F.col("l_shipdate").cast("date"), F.col("l_linenumber")
    period = F.concat(F.lit("自2001年1月1日至 "), F.date_format(d, "yyyy年M月d日"), F.lit("止"))
    flag = F.when(F.col("l_returnflag") == "R", "是").when(F.col("l_returnflag") == "A", "已撤").otherwise(" 否")
    number = F.when(line % 2 == 0, F.concat(F.lit("GR"), F.col("l_partkey").cast("string"))).otherwise("-")
    credit = F.lpad(F.col("l_orderkey").cast("string"), 18, "9")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), line.alias("line"), dates.parse_valid_to(period).alias("valid_to"),
        tags.is_revoked(flag).alias("revoked"),
        tags.certificate_number(number, F.year(d).cast("string"), credit).alias("cert_no"),
    )


@query(
    "query_kinds",
    f"""
    SELECT kind, count(*) AS n FROM (
        SELECT CASE c_custkey % 7 WHEN 0 THEN 'company' WHEN 1 THEN 'phone' WHEN 2 THEN 'email' WHEN 3 THEN 'credit'
                    WHEN 4 THEN 'person' WHEN 5 THEN 'keyword' ELSE 'phone' END AS kind
        FROM customer) AS x GROUP BY kind""",
)
def query_kinds(spark, sf_dir):
    from leadlake.operators.predicates import query_kind

    k = F.col("c_custkey")
    number = F.lpad(k.cast("string"), 8, "0")
    forms = [
        company_name(k), F.concat(F.lit("138-"), number), F.concat(F.lit("A"), number, F.lit("@x.cn ")),
        F.concat(F.lit("91330100ma"), number), pick(("王伟", "欧阳小明", "李·芳"), k % 3),
        pick(("x", "ab", "5g云"), k % 3), F.concat(F.lit("+86 (139) "), number),
    ]
    raw = forms[-1]
    for i, form in enumerate(forms[:-1]):
        raw = F.when(k % 7 == i, form).otherwise(raw)
    kinds = table(spark, sf_dir, "customer").select(query_kind(raw).alias("kind"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "jitter_points",
    f"""
    SELECT code AS credit_code,
           round(c_nationkey + ((h % 1000) / CAST(999 AS DOUBLE) - CAST(0.5 AS DOUBLE)) * 2 * 120
                 / (CAST(111000 AS DOUBLE) * greatest(cos(radians(c_nationkey * 2)), CAST(0.2 AS DOUBLE))), 6) AS lng,
           round(c_nationkey * 2 + ((h // 1000 % 1000) / CAST(999 AS DOUBLE) - CAST(0.5 AS DOUBLE)) * 2 * 120 / CAST(111000 AS DOUBLE), 6) AS lat
    FROM (SELECT code, CAST(c_nationkey AS DOUBLE) AS c_nationkey, CAST('0x' || substr(md5(code), 1, 8) AS BIGINT) AS h
          FROM (SELECT c_nationkey, {code(K)} AS code FROM customer) AS y) AS x""",
)
def jitter_points(spark, sf_dir):
    from leadlake.catalog.domain import company_code

    n = F.col("c_nationkey").cast("double")
    code_column = company_code(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select(
        code_column.alias("credit_code"), geo.jittered(code_column, n, n * 2).alias("p")
    ).select("credit_code", "p.*")


@query(
    "chain_fields",
    """
    SELECT row_no, l1 AS industry,
           l1 || ' / ' || l2 || coalesce(' / ' || l3, '') ||
             CASE WHEN node IS NOT NULL AND node <> coalesce(l3, l2) THEN ' / ' || node ELSE '' END AS node_path,
           h1 || '|' || h2 AS honors, coalesce(financing, '') AS financing
    FROM chain_rows""",
    ("chain_rows",),
)
def chain_fields(spark, sf_dir):
    from leadlake.catalog.domain import chain_rows
    from leadlake.plans.load import chain_tag_rows

    return chain_tag_rows(chain_rows(spark, sf_dir)).select(
        "row_no", "industry", "node_path", "honors", F.coalesce("financing", F.lit("")).alias("financing")
    )


@query(
    "street_by_pattern",
)
def street_by_pattern(spark, sf_dir):
    """Streets read from addresses by pattern, both rules; checked in the tests."""
    from leadlake.catalog.domain import companies

    places = [F.col(p) for p in ("province", "city", "district")]
    c = companies(spark, sf_dir).select("credit_code", *places, "address").withColumns(
        {
            "repeated": street.repeated_region_pattern(*places),
            "regions": street.region_spellings(*places),
            "body": street.without_zone(street.without_prefix(F.col("address"), street.prefix_pattern(*places))),
        }
    )
    return c.select(
        "credit_code",
        street.scanned_street(F.col("body"), F.col("repeated"), F.col("regions")).alias("scanned"),
        street.leading_street(F.col("address"), *places).alias("leading"),
    )
