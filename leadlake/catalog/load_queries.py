"""Loads, upserts, enrichment and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.catalog import vocabulary as v
from leadlake.catalog.domain import (
    as_of,
    chain_rows,
    companies,
    company_code,
    company_name,
    contact_status_changes,
    contact_value,
    contacts,
    pick,
    qualifications,
    registry_rows,
    table,
    tags,
    whole,
)
from leadlake.catalog.domain import territory as territory_table
from leadlake.catalog.domain_sql import code, cvalue, mobile, name, pick as pick_sql
from leadlake.catalog.entry import query
from leadlake.functions.identity import entity_code
from leadlake.functions.text import lookup
from leadlake.operators import profile, upsert
from leadlake.operators.ranking import keep_best, keep_last
from leadlake.plans import load
from leadlake.plans.national import repaired_capital
from leadlake.schemas import COMPANIES, conform

ARRIVAL = ["src_file", "row_no"]


@query(
    "keep_best_row",
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                     ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_shipdate) AS rn
        FROM lineitem) AS x WHERE rn = 1""",
)
def keep_best_row(spark, sf_dir):
    best = keep_best(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_extendedprice",
        ["l_partkey", "l_suppkey", "l_shipdate"],
    )
    return best.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")


REGISTRY_BEST = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY credit_code ORDER BY fill_score DESC, src_file, row_no) AS rn
                   FROM registry_rows) AS x WHERE rn = 1"""


@query(
    "registry_load",
    f"""
    SELECT credit_code, company_name, status, legal_person, scale, CAST(capital_wan AS DOUBLE) AS capital_wan,
           CAST(established AS VARCHAR) AS established, year(established) AS established_year,
           CAST(round(date_diff('day', established, DATE '{v.AS_OF}') / 365.25, 1) AS DOUBLE) AS company_age,
           province, city, district, industry_l1, insured_count, address, scope, fill_score, src_file,
           1 AS has_mobile, 1 AS has_landline, 1 AS has_email, 2 AS mobile_count,
           CASE WHEN e2 IS NULL THEN 1 ELSE 2 END AS email_count
    FROM ({REGISTRY_BEST}) AS best""",
    ("registry_rows",),
)
def registry_load(spark, sf_dir):
    keyed = load.keyed_registry(registry_rows(spark, sf_dir), limits=True)
    return load.registry_companies(keyed, as_of(), ARRIVAL, limits=True).select(
        "credit_code", "company_name", "status", "legal_person", "scale", "capital_wan", "established",
        "established_year", "company_age", "province", "city", "district", "industry_l1", "insured_count",
        "address", "scope", "fill_score", "src_file", "has_mobile", "has_landline", "has_email",
        "mobile_count", "email_count",
    )


@query(
    "registry_contacts",
    """
    WITH points AS (
        SELECT credit_code, 'mobile' AS contact_type, m1 AS contact_value, 1 AS is_primary, src_file, row_no, 0 AS pos FROM registry_rows
        UNION ALL SELECT credit_code, 'mobile', m2, 0, src_file, row_no, 1 FROM registry_rows
        UNION ALL SELECT credit_code, 'landline', l1, 1, src_file, row_no, 2 FROM registry_rows
        UNION ALL SELECT credit_code, 'email', e1, 1, src_file, row_no, 3 FROM registry_rows
        UNION ALL SELECT credit_code, 'email', e2, 0, src_file, row_no, 4 FROM registry_rows WHERE e2 IS NOT NULL)
    SELECT credit_code, contact_type, contact_value, is_primary FROM (
        SELECT *, row_number() OVER (PARTITION BY credit_code, contact_type, contact_value ORDER BY src_file, row_no, pos) AS rn
        FROM points) AS x WHERE rn = 1""",
    ("registry_rows",),
)
def registry_contacts(spark, sf_dir):
    keyed = load.keyed_registry(registry_rows(spark, sf_dir), limits=True)
    points = load.registry_contacts(keyed, ARRIVAL, "registry", F.lit("2025-01-01").cast("date"))
    return points.select("credit_code", "contact_type", "contact_value", "is_primary")


@query(
    "monthly_fold",
    f"""
    WITH m AS (SELECT o_orderkey AS o, o_custkey AS c, {code('o_custkey')} AS credit_code, {mobile('o_orderkey % 97')} AS mobile,
                      CAST(o_orderdate AS DATE) AS day, o_orderpriority AS src_file,
                      309 + CASE WHEN o_custkey % 9 <> 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS fill
               FROM orders),
         best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY credit_code ORDER BY fill DESC, o) AS rn FROM m) AS x WHERE rn = 1)
    SELECT best.credit_code, CAST(day AS VARCHAR) AS established, fill AS fill_score, n AS mobile_count, 1 AS has_mobile,
           0 AS has_email, CASE WHEN o % 2 = 0 THEN '王伟' END AS legal_person, '上海市' AS city, '宝山区' AS district
    FROM best JOIN (SELECT credit_code, count(DISTINCT mobile) AS n FROM m GROUP BY credit_code) AS c
         ON best.credit_code = c.credit_code""",
)
def monthly_fold(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    credit = F.when(c % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("91"), F.lpad(c.cast("string"), 16, "0")))
    rows = table(spark, sf_dir, "orders").select(
        company_name(c).alias("name"), F.when(o % 2 == 0, "王伟").otherwise("-").alias("legal"),
        F.col("o_orderdate").cast("date").cast("string").alias("established"), F.lit("宝山区某路").alias("address"),
        F.lit("企业").alias("type"), credit.alias("credit"), F.lit("100万元").alias("capital"),
        F.lit("制造业").alias("ind1"), F.lit("上海-宝山区").alias("region"), F.lit("销售").alias("scope"),
        contact_value(F.lit("mobile"), o % 97).alias("mobile"), o.alias("row_no"),
    )
    folded = load.monthly_companies(rows, as_of(), ["row_no"], limits=True)
    return folded.select(
        "credit_code", "established", "fill_score", "mobile_count", "has_mobile", "has_email",
        "legal_person", "city", "district",
    )


# Change rows of an entity table, from the event log.
EVENT_ROWS = """
    SELECT user_id AS k, event_type AS label, CAST(floor(value * 100) AS BIGINT) AS amount,
           CAST(floor(value) AS BIGINT) % 50 AS seq, event_id FROM events"""


def event_rows(spark, sf_dir):
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("k"), F.col("event_type").alias("label"), whole(value * 100).alias("amount"),
        (whole(value) % 50).alias("seq"), "event_id",
    )


def entity_rows(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), F.col("c_mktsegment").alias("label"), whole(F.col("c_acctbal")).alias("amount"),
        (k % 60).alias("seq"), F.lit(-1).cast("long").alias("event_id"),
    )


ENTITY_ROWS = """
    SELECT c_custkey AS k, c_mktsegment AS label, CAST(floor(c_acctbal) AS BIGINT) AS amount, c_custkey % 60 AS seq,
           CAST(-1 AS BIGINT) AS event_id FROM customer"""


@query(
    "upsert_sequence",
    f"""
    SELECT k, label, amount, seq, event_id FROM (
        SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC, src DESC, event_id DESC) AS rn
        FROM (SELECT *, 0 AS src FROM ({ENTITY_ROWS}) AS a UNION ALL SELECT *, 1 FROM ({EVENT_ROWS}) AS b) AS u) AS x
    WHERE rn = 1""",
)
def upsert_sequence(spark, sf_dir):
    return upsert.upsert_rows(
        entity_rows(spark, sf_dir), event_rows(spark, sf_dir), ["k"], "seq", ["event_id"]
    )


@query(
    "upsert_partial",
    f"""
    WITH patch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id DESC) AS rn FROM ({EVENT_ROWS}) AS e) AS x WHERE rn = 1)
    SELECT t.k, t.amount,
           CASE WHEN p.seq >= t.seq THEN CASE WHEN p.label <> 'error' THEN p.label END ELSE t.label END AS label,
           CASE WHEN p.seq >= t.seq THEN p.seq ELSE t.seq END AS seq
    FROM ({ENTITY_ROWS}) AS t LEFT JOIN patch AS p ON t.k = p.k""",
)
def upsert_partial(spark, sf_dir):
    """The patch supplies 'label' (NULL for errors) but not 'amount'."""
    patch = keep_last(event_rows(spark, sf_dir), ["k"], ["event_id"]).withColumn(
        "label", F.when(F.col("label") != "error", F.col("label"))
    )
    changed = upsert.patch_columns(entity_rows(spark, sf_dir), patch, ["label"], ["k"], "seq")
    return changed.select("k", "label", "amount", "seq")


@query(
    "append_contacts",
    f"""
    WITH incoming AS (
        SELECT {code('l_orderkey % 1500')} AS credit_code, 'mobile' AS contact_type, {mobile('l_partkey % 500')} AS contact_value,
               l_returnflag AS source, l_shipdate AS arrived, l_orderkey * 10 + l_linenumber AS no, l_extendedprice AS price FROM lineitem),
    both_ AS (SELECT credit_code, contact_type, contact_value, source, 0 AS inc, CAST(NULL AS TIMESTAMP) AS arrived, CAST(NULL AS BIGINT) AS no, CAST(NULL AS DOUBLE) AS price FROM contacts
              UNION ALL SELECT credit_code, contact_type, contact_value, source, 1, arrived, no, price FROM incoming)
    SELECT source, count(*) AS n, count(DISTINCT credit_code) AS companies FROM (
        SELECT *, row_number() OVER (PARTITION BY credit_code, contact_type, contact_value
                                     ORDER BY inc DESC, arrived DESC, no DESC, price DESC) AS rn FROM both_) AS x
    WHERE rn = 1 GROUP BY source""",
    ("contacts",),
)
def append_contacts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    batch = l.select(
        company_code(F.col("l_orderkey") % 1500).alias("credit_code"), F.lit("mobile").alias("contact_type"),
        contact_value(F.lit("mobile"), F.col("l_partkey") % 500).alias("contact_value"),
        F.col("l_returnflag").alias("source"), F.col("l_shipdate").alias("arrived"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("no"), F.col("l_extendedprice").alias("price"),
    )
    target = contacts(spark, sf_dir).select("credit_code", "contact_type", "contact_value", "source").withColumns(
        {"arrived": F.lit(None).cast("timestamp_ntz"), "no": F.lit(None).cast("long"), "price": F.lit(None).cast("double")}
    )
    merged = upsert.append_contacts(target, batch, ["arrived", "no", "price"])
    return merged.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("credit_code").alias("companies")
    )


@query(
    "slice_refresh",
    f"""
    SELECT label, count(*) AS n, sum(amount) AS amount FROM (
        SELECT label, amount FROM ({EVENT_ROWS}) AS a WHERE label <> 'view'
        UNION ALL SELECT 'view', CAST(floor(c_acctbal) AS BIGINT) FROM customer) AS x
    GROUP BY label""",
)
def slice_refresh(spark, sf_dir):
    fresh = entity_rows(spark, sf_dir).withColumn("label", F.lit("view"))
    refreshed = upsert.replace_slice(event_rows(spark, sf_dir), fresh, "label", "view")
    return refreshed.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query(
    "fill_blank_enrich",
    """
    WITH scored AS (SELECT *, 7 + CASE WHEN status IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN legal_person IS NOT NULL THEN 1 ELSE 0 END
                              + CASE WHEN k % 10 <> 7 THEN 3 ELSE 0 END + CASE WHEN established IS NOT NULL THEN 1 ELSE 0 END
                              + CASE WHEN own_province IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN address IS NOT NULL THEN 1 ELSE 0 END AS own
                    FROM registry_rows WHERE k % 9 <> 0),
         src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY credit_code ORDER BY own DESC, src_file, row_no) AS rn FROM scored) AS x WHERE rn = 1),
         tgt AS (SELECT credit_code, CASE WHEN k % 2 = 1 THEN legal_person END AS legal_person, CASE WHEN k % 3 > 0 THEN established END AS established,
                        CASE WHEN k % 4 > 0 THEN scope ELSE '' END AS scope, fill_score
                 FROM companies WHERE credit_code IN (SELECT credit_code FROM tags))
    SELECT coalesce(t.credit_code, s.credit_code) AS credit_code, coalesce(t.legal_person, s.legal_person) AS legal_person,
           CAST(coalesce(t.established, s.established) AS VARCHAR) AS established,
           CASE WHEN coalesce(t.scope, '') = '' THEN coalesce(s.scope, t.scope) ELSE t.scope END AS scope,
           CASE WHEN t.credit_code IS NULL THEN s.own ELSE t.fill_score
                + CASE WHEN t.legal_person IS NULL AND s.legal_person IS NOT NULL THEN 1 ELSE 0 END
                + CASE WHEN t.established IS NULL AND s.established IS NOT NULL THEN 1 ELSE 0 END
                + CASE WHEN t.scope = '' AND s.scope IS NOT NULL THEN 1 ELSE 0 END END AS fill_score
    FROM tgt AS t FULL JOIN src AS s ON t.credit_code = s.credit_code""",
    ("registry_rows", "companies", "tags"),
)
def fill_blank_enrich(spark, sf_dir):
    """Known companies have gaps that registry rows fill; unknown ones are added."""
    k = F.substring("company_name", 3, 9).cast("long")
    known = companies(spark, sf_dir).join(tags(spark, sf_dir).select("credit_code"), "credit_code", "left_semi")
    gaps = known.withColumns(
        {
            "legal_person": F.when(k % 2 == 1, F.col("legal_person")),
            "established": F.when(k % 3 > 0, F.col("established")),
            "scope": F.when(k % 4 > 0, F.col("scope")).otherwise(""),
        }
    )
    source = load.national_enrichment(registry_rows(spark, sf_dir), ARRIVAL, limits=True)
    enriched = load.enrich_from_national(conform(gaps, COMPANIES), source)
    return enriched.select("credit_code", "legal_person", "established", "scope", "fill_score")


@query(
    "refresh_flags",
    f"""
    WITH touched AS (SELECT DISTINCT {code('user_id')} AS credit_code FROM events),
         kept AS (SELECT * FROM contacts WHERE contact_type <> 'mobile'),
         counts AS (SELECT credit_code, count(*) FILTER (WHERE contact_type = 'landline') AS l,
                           count(*) FILTER (WHERE contact_type = 'email') AS e FROM kept GROUP BY credit_code)
    SELECT c.credit_code,
           CASE WHEN t.credit_code IS NULL THEN c.has_mobile ELSE 0 END AS has_mobile,
           CASE WHEN t.credit_code IS NULL THEN c.has_landline WHEN coalesce(l, 0) > 0 THEN 1 ELSE 0 END AS has_landline,
           CASE WHEN t.credit_code IS NULL THEN c.email_count ELSE coalesce(e, 0) END AS email_count,
           CASE WHEN t.credit_code IS NULL THEN c.fill_score ELSE c.fill_score + 1 END AS fill_score
    FROM companies AS c LEFT JOIN touched AS t ON c.credit_code = t.credit_code
         LEFT JOIN counts AS n ON c.credit_code = n.credit_code""",
    ("companies", "contacts"),
)
def refresh_flags(spark, sf_dir):
    touched = table(spark, sf_dir, "events").select(company_code(F.col("user_id")).alias("credit_code"))
    kept = contacts(spark, sf_dir).filter(F.col("contact_type") != "mobile")
    fresh = upsert.refresh_flags(companies(spark, sf_dir), kept, touched)
    return fresh.select("credit_code", "has_mobile", "has_landline", "email_count", "fill_score")


@query(
    "capital_repair",
    """
    WITH c AS (SELECT k, credit_code, company_name, scale, capital_raw, capital_currency, fill_score,
                      CAST(regexp_extract(replace(capital_raw, ',', ''), '^[0-9.]+') AS DECIMAL(18,2)) AS stated,
                      CAST(round(CASE capital_currency WHEN '美元' THEN 7.2 WHEN '港元' THEN 0.92 WHEN '日元' THEN 0.048 ELSE 1 END
                           * CAST(regexp_extract(replace(capital_raw, ',', ''), '^[0-9.]+') AS DECIMAL(18,2)) * 0.0001, 2) AS DECIMAL(20,2)) AS yuan,
                      capital_wan AS parsed
               FROM companies WHERE k % 10 <> 7),
         dirty AS (SELECT *, CASE WHEN k % 10 IN (5, 6) THEN stated ELSE parsed END AS wan FROM c),
         due AS (SELECT *, contains(company_name, '中国铁路') AS owned, contains(company_name, '工会') AS body FROM dirty
                 WHERE wan >= 1000000 OR k % 10 IN (5, 6)),
         ruled AS (SELECT *, CASE WHEN NOT owned AND body AND k % 10 <> 3 AND k % 10 <> 4 AND stated >= 1000000 THEN 'branch_as_yuan'
                                  WHEN wan >= 1000000 AND NOT owned AND (scale = '微型' OR body) THEN 'micro_or_branch'
                                  WHEN wan >= 10000000 AND (NOT owned OR coalesce(scale, '') IN ('小型', '微型')) THEN 'ge1000yi_non_soe'
                                  ELSE 'parse_capital' END AS reason FROM due),
         priced AS (SELECT *, CASE WHEN reason = 'parse_capital' THEN parsed ELSE yuan END AS new_wan FROM ruled)
    SELECT reason, count(*) AS n, CAST(sum(new_wan) AS DOUBLE) AS wan, sum(fill_score + 1) AS score FROM priced
    WHERE abs(wan - new_wan) >= 0.02 AND new_wan <= wan + 0.02
      AND NOT (owned AND new_wan < wan * 0.5 AND coalesce(scale, '') NOT IN ('小型', '微型'))
    GROUP BY reason""",
    ("companies",),
)
def capital_repair(spark, sf_dir):
    """Companies still hold the amounts as stated; the repair lists its changes."""
    c = companies(spark, sf_dir)
    stated = F.regexp_extract("capital_raw", r"^1[0-9]{7,}(?=万元$)", 0)
    dirty = c.withColumn(
        "capital_wan",
        F.when(stated != "", stated.try_cast("decimal(20,2)")).otherwise(F.col("capital_wan")),
    )
    return repaired_capital(dirty).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("capital_wan").alias("wan"), F.sum("fill_score").alias("score")
    )


@query(
    "edit_batch",
    f"""
    WITH edits AS (SELECT {code('user_id')} AS credit_code, event_id,
                          CASE event_type WHEN 'view' THEN 'website' WHEN 'click' THEN 'street' WHEN 'signup' THEN 'scope'
                               WHEN 'purchase' THEN 'capital_wan' ELSE 'fill_score' END AS field,
                          CASE event_type WHEN 'purchase' THEN CAST(event_id % 100000 AS VARCHAR) ELSE 'v' || CAST(event_id AS VARCHAR) END AS value FROM events),
         last_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY credit_code, field ORDER BY event_id DESC) AS rn
                                  FROM edits WHERE field <> 'fill_score') AS x WHERE rn = 1),
         wide AS (SELECT credit_code, max(value) FILTER (WHERE field = 'website') AS website, max(value) FILTER (WHERE field = 'street') AS street,
                         max(value) FILTER (WHERE field = 'scope') AS scope, max(value) FILTER (WHERE field = 'capital_wan') AS capital FROM last_ GROUP BY credit_code)
    SELECT c.credit_code, coalesce(w.website, c.website) AS website, coalesce(w.street, c.street) AS street,
           coalesce(w.scope, c.scope) AS scope, CAST(coalesce(CAST(w.capital AS DECIMAL(20,2)), c.capital_wan) AS DOUBLE) AS capital_wan,
           c.fill_score + CASE WHEN w.credit_code IS NULL THEN 0 ELSE 1 END AS fill_score
    FROM companies AS c LEFT JOIN wide AS w ON c.credit_code = w.credit_code""",
    ("companies",),
)
def edit_batch(spark, sf_dir):
    edited = upsert.edit_companies(companies(spark, sf_dir), company_edits(spark, sf_dir), ["event_id"])
    return edited.select("credit_code", "website", "street", "scope", "capital_wan", "fill_score")


def company_edits(spark, sf_dir):
    e = F.col("event_id")
    fields = {"view": "website", "click": "street", "signup": "scope", "purchase": "capital_wan", "error": "fill_score"}
    mapped = lookup(fields, F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        company_code(F.col("user_id")).alias("credit_code"), mapped.alias("field"),
        F.when(F.col("event_type") == "purchase", (e % 100000).cast("string"))
        .otherwise(F.concat(F.lit(" v"), e.cast("string"), F.lit("　"))).alias("value"), "event_id",
    )

def contact_changes(spark, sf_dir):
    e = F.col("event_id")
    kinds = {"view": "mobile", "click": " Email ", "signup": "landline", "purchase": "fax", "error": "mobile"}
    mapped = lookup(kinds, F.col("event_type"))
    value = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("+86 138-"), F.lpad((e % 5000).cast("string"), 8, "0")))
        .when(F.col("event_type") == "click", F.concat(F.lit("U"), (e % 400).cast("string"), F.lit("@Mail.cn")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("021 "), F.lpad((e % 3000).cast("string"), 8, "0")))
        .otherwise(F.lit("abc"))
    )
    return table(spark, sf_dir, "events").select(
        company_code(F.col("user_id")).alias("credit_code"), mapped.alias("contact_type"),
        value.alias("contact_value"), F.lit(0).cast("tinyint").alias("is_primary"), "event_id",
    )


@query(
    "contact_add",
    f"""
    WITH added AS (SELECT DISTINCT {code('user_id')} AS credit_code,
                          CASE event_type WHEN 'view' THEN 'mobile' WHEN 'click' THEN 'email' ELSE 'landline' END AS contact_type,
                          CASE event_type WHEN 'view' THEN '138' || lpad(CAST(event_id % 5000 AS VARCHAR), 8, '0')
                               WHEN 'click' THEN 'u' || CAST(event_id % 400 AS VARCHAR) || '@mail.cn'
                               ELSE '021' || lpad(CAST(event_id % 3000 AS VARCHAR), 8, '0') END AS contact_value
                   FROM events JOIN customer ON user_id = c_custkey WHERE event_type IN ('view', 'click', 'signup')),
         all_ AS (SELECT credit_code, contact_type, contact_value FROM contacts UNION SELECT * FROM added),
         counts AS (SELECT credit_code, count(*) FILTER (WHERE contact_type = 'mobile') AS m, count(*) FILTER (WHERE contact_type = 'email') AS e FROM all_ GROUP BY credit_code)
    SELECT c.credit_code, CASE WHEN t.credit_code IS NULL THEN c.mobile_count ELSE m END AS mobile_count,
           CASE WHEN t.credit_code IS NULL THEN c.email_count ELSE e END AS email_count
    FROM companies AS c LEFT JOIN (SELECT DISTINCT credit_code FROM added) AS t ON c.credit_code = t.credit_code
         LEFT JOIN counts AS n ON c.credit_code = n.credit_code""",
    ("companies", "contacts"),
)
def contact_add(spark, sf_dir):
    c = companies(spark, sf_dir)
    _, flagged, _ = upsert.add_contacts(c, contacts(spark, sf_dir), contact_changes(spark, sf_dir), ["event_id"])
    return flagged.select("credit_code", "mobile_count", "email_count")


@query(
    "contact_add_rejects",
    """
    SELECT CASE event_type WHEN 'purchase' THEN 'unknown type' WHEN 'error' THEN 'not a phone number' ELSE 'unknown company' END AS reject_reason, count(*) AS n
    FROM events WHERE event_type IN ('purchase', 'error') OR user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""",
)
def contact_add_rejects(spark, sf_dir):
    _, _, rejected = upsert.add_contacts(
        companies(spark, sf_dir), contacts(spark, sf_dir), contact_changes(spark, sf_dir), ["event_id"],
    )
    return rejected.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "contact_delete",
    f"""
    WITH gone AS (SELECT {code('o_custkey')} AS credit_code, {cvalue("'mobile'", 'o_orderkey')} AS contact_value FROM orders WHERE o_orderstatus = 'F'),
         kept AS (SELECT * FROM contacts AS t WHERE NOT (contact_type = 'mobile' AND EXISTS (SELECT 1 FROM gone AS g WHERE g.credit_code = t.credit_code AND g.contact_value = t.contact_value)))
    SELECT contact_type, count(*) AS n, count(DISTINCT credit_code) AS companies FROM kept GROUP BY contact_type""",
    ("contacts",),
)
def contact_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select(
        company_code(F.col("o_custkey")).alias("credit_code"), F.lit("Mobile ").alias("contact_type"),
        contact_value(F.lit("mobile"), F.col("o_orderkey")).alias("contact_value"),
    )
    kept, _ = upsert.delete_contacts(companies(spark, sf_dir), contacts(spark, sf_dir), gone)
    return kept.groupBy("contact_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("credit_code").alias("companies")
    )


@query(
    "status_latest",
    "SELECT credit_code, user_id, status, note FROM contact_status",
    ("contact_status",),
)
def status_latest(spark, sf_dir):
    latest = upsert.latest_status(contact_status_changes(spark, sf_dir), ("updated_at", "event_id"))
    return latest.select("credit_code", "user_id", "status", "note")


@query(
    "status_rejects",
    "SELECT 'unknown state' AS reject_reason, event_id FROM events WHERE event_type = 'error'",
)
def status_rejects(spark, sf_dir):
    checked = upsert.checked_status(contact_status_changes(spark, sf_dir))
    return checked.filter(F.col("reject_reason").isNotNull()).select("reject_reason", "event_id")


@query(
    "edit_rejects",
    "SELECT 'field not editable' AS reject_reason, event_id FROM events WHERE event_type = 'error'",
)
def edit_rejects(spark, sf_dir):
    checked = upsert.checked_edits(company_edits(spark, sf_dir))
    return checked.filter(F.col("reject_reason").isNotNull()).select("reject_reason", "event_id")


@query(
    "territory_rules",
    f"""
    SELECT 'u' || CAST(c_custkey % 3 AS VARCHAR) AS user_id, {pick_sql(v.PROVINCES, 'CAST(c_nationkey AS BIGINT)')} AS province,
           {pick_sql(v.CITIES, 'CAST(c_nationkey AS BIGINT)')} AS city, '' AS district, '' AS street, max(c_custkey) AS loaded_at
    FROM customer GROUP BY ALL""",
)
def territory_rules(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    changes = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), (k % 3).cast("string")).alias("user_id"), pick(v.PROVINCES, n).alias("province"),
        pick(v.CITIES, n).alias("city"), F.lit("").alias("district"), F.lit("").alias("street"),
        k.alias("loaded_at"),
    )
    return upsert.territory_rules(changes)


@query(
    "chain_tag_merge",
    """
    WITH touched AS (SELECT DISTINCT credit_code FROM chain_rows),
    old AS (SELECT t.* FROM tags AS t JOIN touched USING (credit_code)),
    vals AS (
        SELECT credit_code, 'i' AS kind, trim(x) AS value, 0 AS inc, '' AS f, 0 AS r, p
        FROM (SELECT credit_code, unnest(xs) AS x, unnest(range(len(xs))) AS p
              FROM (SELECT credit_code, string_split(array_to_string(chain_industries, ' | '), ' | ') AS xs FROM old) AS o) AS u
        UNION ALL SELECT credit_code, 'i', l1, 1, src_file, row_no, 0 FROM chain_rows
        UNION ALL SELECT credit_code, 'n', chain_nodes[1], 0, '', 0, 0 FROM old
        UNION ALL SELECT credit_code, 'n', l1 || ' / ' || l2 || coalesce(' / ' || l3, '') ||
             CASE WHEN node IS NOT NULL AND node <> coalesce(l3, l2) THEN ' / ' || node ELSE '' END, 1, src_file, row_no, 0 FROM chain_rows
        UNION ALL SELECT credit_code, 'h', honors[1], 0, '', 0, 0 FROM old WHERE honors IS NOT NULL
        UNION ALL SELECT credit_code, 'h', h1, 1, src_file, row_no, 0 FROM chain_rows
        UNION ALL SELECT credit_code, 'h', h2, 1, src_file, row_no, 1 FROM chain_rows
        UNION ALL SELECT credit_code, 'p', w, inc, f, r, p FROM (
            SELECT credit_code, chain_positions AS t, 0 AS inc, '' AS f, 0 AS r FROM old
            UNION ALL SELECT credit_code, position, 1, src_file, row_no FROM chain_rows) AS q,
            (VALUES ('上游', 0), ('中游', 1), ('下游', 2)) AS ws(w, p) WHERE contains(t, w)),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY credit_code, kind, value ORDER BY inc, f, r, p) AS rn FROM vals),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY credit_code, kind ORDER BY inc, f, r, p) AS pos FROM firsts WHERE rn = 1),
    lists AS (SELECT credit_code, string_agg(value, '|' ORDER BY pos) FILTER (WHERE kind = 'i') AS industries,
                     string_agg(value, '|' ORDER BY pos) FILTER (WHERE kind = 'n') AS chain_nodes,
                     string_agg(value, '|' ORDER BY pos) FILTER (WHERE kind = 'h') AS honors,
                     string_agg(value, '、' ORDER BY pos) FILTER (WHERE kind = 'p') AS chain_positions FROM ranked GROUP BY credit_code),
    rels AS (SELECT credit_code, max(CASE relatedness WHEN '强' THEN 3 WHEN '较强' THEN 2 WHEN '中' THEN 1 ELSE 0 END) AS rk
             FROM (SELECT credit_code, relatedness FROM old UNION ALL SELECT credit_code, relatedness FROM chain_rows) AS z GROUP BY credit_code),
    fins AS (SELECT credit_code, arg_max(financing, inc || f || lpad(CAST(r AS VARCHAR), 20, '0')) AS financing_raw
             FROM (SELECT credit_code, financing_raw AS financing, '0' AS inc, '' AS f, 0 AS r FROM old
                   UNION ALL SELECT credit_code, financing, '1', src_file, row_no FROM chain_rows WHERE financing IS NOT NULL) AS z GROUP BY credit_code)
    SELECT coalesce(t.credit_code, l.credit_code) AS credit_code,
           CASE WHEN l.credit_code IS NULL THEN array_to_string(t.chain_industries, '|') ELSE l.industries END AS industries,
           CASE WHEN l.credit_code IS NULL THEN array_to_string(t.chain_nodes, '|') ELSE l.chain_nodes END AS chain_nodes,
           CASE WHEN l.credit_code IS NULL THEN array_to_string(t.honors, '|') ELSE l.honors END AS honors,
           CASE WHEN l.credit_code IS NULL THEN t.chain_positions ELSE l.chain_positions END AS chain_positions,
           CASE WHEN l.credit_code IS NULL THEN t.relatedness ELSE ['弱', '中', '较强', '强'][rk + 1] END AS relatedness,
           CASE WHEN l.credit_code IS NULL THEN NULL WHEN contains(n.financing_raw, '上市') THEN '已上市' WHEN n.financing_raw = '未融资' THEN '未融资'
                WHEN n.financing_raw = '-' THEN '未知' ELSE '有融资信号' END AS tag_finance, t.lead_score
    FROM tags AS t FULL JOIN lists AS l ON t.credit_code = l.credit_code
         LEFT JOIN rels AS r ON r.credit_code = l.credit_code LEFT JOIN fins AS n ON n.credit_code = l.credit_code""",
    ("tags", "chain_rows"),
)
def chain_tag_merge(spark, sf_dir):
    rows = load.chain_tag_rows(chain_rows(spark, sf_dir), limits=True)
    merged = load.merge_tags(tags(spark, sf_dir), rows, ARRIVAL)
    return merged.select(
        "credit_code", F.col("chain_industries").alias("industries"), "chain_nodes", "honors",
        "chain_positions", "relatedness", "tag_finance", "lead_score",
    )


@query(
    "honor_append",
    f"""
    WITH certified AS (SELECT DISTINCT credit_code FROM qualifications WHERE revoked = 0)
    SELECT coalesce(t.credit_code, c.credit_code) AS credit_code,
           CASE WHEN c.credit_code IS NULL THEN array_to_string(t.honors, '|')
                WHEN t.honors IS NULL THEN '高新技术企业'
                WHEN list_contains(t.honors, '高新技术企业') THEN array_to_string(t.honors, '|')
                ELSE array_to_string(t.honors, '|') || '|高新技术企业' END AS honors, t.lead_score
    FROM tags AS t FULL JOIN certified AS c ON t.credit_code = c.credit_code""",
    ("tags", "qualifications"),
)
def honor_append(spark, sf_dir):
    certified = qualifications(spark, sf_dir).filter(F.col("revoked") == 0)
    return load.add_honor(tags(spark, sf_dir), certified).select("credit_code", "honors", "lead_score")


@query(
    "certificate_load",
    f"""
    WITH lines AS (SELECT {code('o_custkey')} AS credit_code, o_custkey AS c, l_linenumber AS line, year(l_shipdate) AS y, CAST(l_shipdate AS DATE) AS d,
                          CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS revoked,
                          l_orderkey AS o, l_partkey AS p, l_suppkey AS s
                   FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 9 <> 0),
         named AS (SELECT *, CASE WHEN line % 2 = 0 THEN 'GR' || CAST(p % 50 AS VARCHAR) ELSE 'HT-' || CAST(y AS VARCHAR) || '-' || right(credit_code, 8) END AS cert_no FROM lines)
    SELECT cert_no, credit_code, CAST(y AS VARCHAR) AS cert_year, CAST(d AS VARCHAR) AS valid_to, revoked FROM (
        SELECT *, row_number() OVER (PARTITION BY credit_code, cert_no ORDER BY o DESC, line DESC, p DESC, s DESC, d DESC) AS rn FROM named) AS x
    WHERE rn = 1""",
)
def certificate_load(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    c, d = F.col("o_custkey"), F.col("l_shipdate").cast("date")
    rows = lines.select(
        company_name(c).alias("name"),
        F.when(c % 9 == 0, "无").otherwise(F.concat(F.lit("91"), F.lpad(c.cast("string"), 16, "0"))).alias("credit"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("GR"), (F.col("l_partkey") % 50).cast("string")))
        .otherwise("").alias("cert_no"),
        F.year(d).cast("string").alias("year"), F.lit("").alias("issue_date"),
        F.concat(F.lit("至"), F.date_format(d, "yyyy年MM月dd日")).alias("valid_to"),
        F.when(F.col("l_returnflag") == "N", "否").otherwise("是").alias("revoked"),
        F.col("l_orderkey").alias("a1"), F.col("l_linenumber").alias("a2"), F.col("l_partkey").alias("a3"),
        F.col("l_suppkey").alias("a4"), d.alias("a5"),
    )
    certs = load.certificates(rows, "table", ["a1", "a2", "a3", "a4", "a5"], limits=True)
    return certs.select("cert_no", "credit_code", "cert_year", "valid_to", "revoked")


@query(
    "preserve_check",
    f"""
    WITH edits AS (SELECT {code('user_id')} AS credit_code, event_id,
                          CASE event_type WHEN 'view' THEN 'website' WHEN 'click' THEN 'street' ELSE 'scope' END AS field,
                          'v' || CAST(event_id AS VARCHAR) AS value FROM events WHERE event_type IN ('view', 'click', 'signup')),
         last_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY credit_code, field ORDER BY event_id DESC) AS rn FROM edits) AS x WHERE rn = 1),
         cells AS (SELECT credit_code, 'website' AS field, website AS before FROM companies UNION ALL SELECT credit_code, 'street', street FROM companies
                   UNION ALL SELECT credit_code, 'scope', scope FROM companies)
    SELECT c.credit_code, c.field, c.before, l.value AS after FROM cells AS c JOIN last_ AS l ON c.credit_code = l.credit_code AND c.field = l.field
    WHERE coalesce(c.before, '') <> '' AND c.before <> l.value""",
    ("companies",),
)
def preserve_check(spark, sf_dir):
    """Cells that manual edits overwrote, as the check after an enrichment lists them."""
    before = companies(spark, sf_dir)
    after = upsert.edit_companies(before, company_edits(spark, sf_dir), ["event_id"])
    return upsert.changed_cells(before, after, ("website", "street", "scope", "legal_person"))


@query(
    "enrichment_contacts",
    """
    WITH best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY credit_code ORDER BY fill_score
                      - CASE WHEN scale IS NOT NULL THEN 1 ELSE 0 END - CASE WHEN e2 IS NOT NULL THEN 1 ELSE 0 END
                      + CASE WHEN k % 10 <> 7 THEN 2 ELSE 0 END + CASE WHEN scale IS NOT NULL THEN 1 ELSE 0 END
                      + CASE WHEN status IS NULL AND false THEN 1 ELSE 0 END
                      - CASE WHEN established IS NULL THEN 1 ELSE 0 END DESC, src_file, row_no) AS rn
                  FROM registry_rows WHERE k % 9 <> 0) AS x WHERE rn = 1)
    SELECT credit_code, 'mobile' AS contact_type, m1 AS contact_value, 0 AS is_primary FROM best
    UNION ALL SELECT credit_code, 'mobile', m2, 0 FROM best
    UNION ALL SELECT credit_code, 'landline', l1, 0 FROM best
    UNION ALL SELECT credit_code, 'email', e, 0 FROM (SELECT credit_code, e2 AS e FROM best WHERE e2 IS NOT NULL AND e2 <> e1
              UNION ALL SELECT credit_code, e1 FROM best) AS es""",
    ("registry_rows",),
)
def enrichment_contacts(spark, sf_dir):
    """Contacts of the fullest chain row per company. A number repeated in the
    cell loses its primary mark, because the last of equal ones stays."""
    best = load.chain_enrichment(registry_rows(spark, sf_dir), ARRIVAL, limits=True)
    points = load.enrichment_contacts(best, ARRIVAL, "chain", F.lit("2025-01-01").cast("date"))
    return points.select("credit_code", "contact_type", "contact_value", "is_primary")


@query(
    "load_metrics",
    """
    SELECT src_file, sum(n) AS "rows", 0 AS bad_rows, count(*) AS companies,
           count(*) FILTER (WHERE credit_code LIKE 'N%') AS surrogate, sum(n) - count(*) AS duplicates
    FROM (SELECT src_file, credit_code, count(*) AS n FROM registry_rows GROUP BY src_file, credit_code) AS x
    GROUP BY src_file""",
    ("registry_rows",),
)
def load_metrics(spark, sf_dir):
    keyed = registry_rows(spark, sf_dir).select(
        "src_file", entity_code(F.col("credit"), F.trim(F.regexp_replace("name", "　", ""))).alias("credit_code")
    )
    return profile.load_report(keyed, "src_file", "credit_code")
