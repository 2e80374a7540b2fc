"""Profiles, key sets, keyword search, percentiles and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.catalog import domain as d
from leadlake.catalog import vocabulary as v
from leadlake.catalog.domain_sql import code, cvalue, pick
from leadlake.catalog.entry import query, query_like
from leadlake.functions.tokens import WORD
from leadlake.operators import profile, setops
from leadlake.operators.ranking import exact_percentiles
from leadlake.operators.search_index import best_any, build_postings, match_all, write_postings
from leadlake.session import work_dir
from leadlake.sources.files import spread
from leadlake.streaming import increments

RAW = profile.Dataset(
    credit="credit", status="status", province="province", city="city", industry="ind1", scale="scale",
    established="established", capital="capital", insured="insured", scope="scope", address="address",
    mobile=("mobile",), landline=("landline",), email=("email", "email2"),
)


@query(
    "profile_columns",
    """
    WITH c AS (SELECT 'text' AS "column", count(*) AS "rows", count(*) FILTER (WHERE trim(text) <> '') AS filled, sum(strlen(text)) AS bytes FROM documents
               UNION ALL SELECT 'lang', count(*), count(lang), sum(strlen(lang)) FROM documents
               UNION ALL SELECT 'source', count(*), count(source), sum(strlen(source)) FROM documents
               UNION ALL SELECT 'n_chars', count(*), count(n_chars), sum(strlen(CAST(n_chars AS VARCHAR))) FROM documents)
    SELECT *, round(filled * 100 / "rows", 2) AS filled_pct, round(bytes / "rows", 1) AS avg_bytes FROM c""",
)
def profile_columns(spark, sf_dir):
    return profile.column_profile(d.table(spark, sf_dir, "documents"), ["text", "lang", "source", "n_chars"])


@query(
    "profile_registry",
    """
    WITH c AS (SELECT 'legal' AS "column", count(*) AS "rows", count(legal_person) AS filled FROM registry_rows
               UNION ALL SELECT 'status', count(*), count(status) FROM registry_rows
               UNION ALL SELECT 'email2', count(*), count(e2) FROM registry_rows
               UNION ALL SELECT 'address', count(*), count(address) FROM registry_rows)
    SELECT *, round(filled * 100 / "rows", 2) AS filled_pct FROM c""",
    ("registry_rows",),
)
def profile_registry(spark, sf_dir):
    columns = ["legal", "status", "email2", "address"]
    return profile.column_profile(d.registry_rows(spark, sf_dir), columns).select("column", "rows", "filled", "filled_pct")


@query(
    "credit_validity",
    """
    SELECT CASE o_custkey % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'empty' ELSE 'malformed' END AS kind, count(*) AS n
    FROM orders GROUP BY o_custkey % 3""",
)
def credit_validity(spark, sf_dir):
    k = F.col("o_custkey")
    forms = (
        F.when(k % 3 == 0, F.concat(F.lit(" 91a"), F.lpad(k.cast("string"), 15, "0")))
        .when(k % 3 == 1, F.when(k % 2 == 0, "暂无").otherwise(" "))
        .otherwise(F.concat(F.lit("91-"), k.cast("string")))
    )
    return profile.credit_validity(d.table(spark, sf_dir, "orders").select(forms.alias("credit")), "credit")


@query(
    "value_topn",
    """
    WITH dims AS (SELECT 'lang' AS dim, lang AS k FROM documents UNION ALL SELECT 'source', source FROM documents
                  UNION ALL SELECT 'size', CAST(n_chars // 100 AS VARCHAR) FROM documents),
         counts AS (SELECT dim, k, count(*) AS n FROM dims GROUP BY dim, k)
    SELECT dim, k, n FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n DESC, k) AS rn FROM counts) AS x WHERE rn <= 10""",
)
def value_topn(spark, sf_dir):
    dims = {
        "lang": F.col("lang"), "source": F.col("source"),
        "size": F.floor(F.col("n_chars") / 100).cast("string"),
    }
    return profile.value_tops(d.table(spark, sf_dir, "documents"), dims, 10)


@query(
    "registry_dimensions",
    f"""
    WITH dims AS (SELECT 'status' AS dim, trim({pick(v.STATUS_RAW, 'k * 3 % 8')}) AS k FROM registry_rows
                  UNION ALL SELECT 'scale', scale FROM registry_rows UNION ALL SELECT 'industry', industry_l1 FROM registry_rows
                  UNION ALL SELECT 'currency', CASE k % 10 WHEN 0 THEN '元人民币' WHEN 1 THEN '美元' WHEN 7 THEN '未填' WHEN 8 THEN '港元' WHEN 9 THEN '日元' ELSE '人民币' END FROM registry_rows),
         counts AS (SELECT dim, k, count(*) AS n FROM dims WHERE k IS NOT NULL AND k <> '-' GROUP BY dim, k)
    SELECT dim, k, n FROM counts""",
    ("registry_rows",),
)
def registry_dimensions(spark, sf_dir):
    dims = profile.dataset_dimensions(RAW)
    kept = {k: dims[k] for k in ("status", "scale", "industry", "currency")}
    return profile.value_tops(d.registry_rows(spark, sf_dir), kept, 60)


@query(
    "histograms",
    """
    WITH m AS (SELECT 'scope_len' AS measure, CASE WHEN n >= 1600 THEN '>=1600' WHEN n >= 800 THEN '800-1599' WHEN n >= 400 THEN '400-799' WHEN n >= 200 THEN '200-399'
                      WHEN n >= 100 THEN '100-199' WHEN n >= 50 THEN '50-99' WHEN n >= 1 THEN '1-49' ELSE '0-0' END AS bucket
               FROM (SELECT length(text) AS n FROM documents) AS x
               UNION ALL
               SELECT 'insured', CASE WHEN n >= 1000 THEN '>=1000' WHEN n >= 200 THEN '200-999' WHEN n >= 50 THEN '50-199' WHEN n >= 20 THEN '20-49' WHEN n >= 5 THEN '5-19' WHEN n >= 1 THEN '1-4' ELSE '0' END
               FROM (SELECT n_chars AS n FROM documents) AS y)
    SELECT measure, bucket, count(*) AS n FROM m GROUP BY measure, bucket""",
)
def histograms(spark, sf_dir):
    docs = d.table(spark, sf_dir, "documents").select(
        F.col("text").alias("scope"), F.col("n_chars").cast("string").alias("insured")
    )
    return profile.histograms(docs, profile.Dataset(credit="", scope="scope", insured="insured"))


@query(
    "capital_histogram",
    """
    WITH w AS (SELECT CASE k % 10 WHEN 7 THEN NULL WHEN 5 THEN CAST(regexp_extract(capital_raw, '^[0-9]+') AS DOUBLE) WHEN 6 THEN CAST(regexp_extract(capital_raw, '^[0-9]+') AS DOUBLE)
                           ELSE CAST(capital_wan AS DOUBLE) END AS n FROM registry_rows)
    SELECT 'capital_wan' AS measure, CASE WHEN n IS NULL THEN '未知' WHEN n >= 10000 THEN '>=10000' WHEN n >= 5000 THEN '5000-9999' WHEN n >= 1000 THEN '1000-4999' WHEN n >= 500 THEN '500-999'
           WHEN n >= 100 THEN '100-499' WHEN n >= 50 THEN '50-99' WHEN n >= 10 THEN '10-49' ELSE '0-9' END AS bucket, count(*) AS n
    FROM w GROUP BY 2""",
    ("registry_rows",),
)
def capital_histogram(spark, sf_dir):
    return profile.histograms(d.registry_rows(spark, sf_dir), profile.Dataset(credit="", capital="capital"))


@query(
    "reach_matrix",
    """
    SELECT src_group, count(*) AS "rows", count(*) AS mobile, count(*) AS landline, count(*) AS email, count(*) AS phone,
           count(*) AS mobile_and_email, count(*) AS reachable, 0 AS unreachable, 100.0::DOUBLE AS reach_pct
    FROM registry_rows GROUP BY src_group""",
    ("registry_rows",),
)
def reach_matrix(spark, sf_dir):
    return profile.group_report(d.registry_rows(spark, sf_dir), RAW, "src_group")


@query(
    "reach_by_channel",
    """
    SELECT count(*) AS "rows", count(*) FILTER (WHERE m) AS mobile, count(*) FILTER (WHERE l) AS landline, count(*) FILTER (WHERE e) AS email,
           count(*) FILTER (WHERE m OR l) AS phone, count(*) FILTER (WHERE m AND e) AS mobile_and_email,
           count(*) FILTER (WHERE m OR l OR e) AS reachable, count(*) FILTER (WHERE NOT (m OR l OR e)) AS unreachable
    FROM (SELECT o_orderkey % 3 = 0 AS m, o_custkey % 4 = 0 AS l, o_orderkey % 5 = 0 AS e FROM orders) AS x""",
)
def reach_by_channel(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = d.table(spark, sf_dir, "orders").select(
        F.when(o % 3 == 0, F.concat(d.contact_value(F.lit("mobile"), o), F.lit(";99"))).otherwise("-").alias("m"),
        F.when(c % 4 == 0, d.contact_value(F.lit("landline"), o)).otherwise("无").alias("l"),
        F.when(o % 5 == 0, d.contact_value(F.lit("email"), o)).alias("e"),
    )
    return profile.reach_matrix(rows, profile.Dataset(credit="", mobile=("m",), landline=("l",), email=("e",)))


@query(
    "mobiles_per_row",
    """
    SELECT least(n, 5) AS mobiles, count(*) AS n FROM (SELECT o_orderkey % 7 AS n FROM orders) AS x GROUP BY least(n, 5)""",
)
def mobiles_per_row(spark, sf_dir):
    o = F.col("o_orderkey")
    numbers = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: i < o % 7),
        lambda i: d.contact_value(F.lit("mobile"), o + i),
    )
    rows = d.table(spark, sf_dir, "orders").select(F.array_join(numbers, "，").alias("m"))
    return profile.mobiles_per_row(rows, profile.Dataset(credit="", mobile=("m",)))


@query(
    "header_census",
    """
    SELECT 'id|url' || CASE WHEN page_id % 3 = 0 THEN '|title' ELSE '' END || CASE WHEN contains(url, '?') THEN '|query' ELSE '' END AS signature,
           count(*) AS files, max(2 + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN contains(url, '?') THEN 1 ELSE 0 END) AS "columns"
    FROM pages GROUP BY 1""",
)
def header_census(spark, sf_dir):
    """Pages stand for files whose header depends on what they contain."""
    headers = F.filter(
        F.array(
            F.lit("id"), F.lit("url"), F.when(F.col("page_id") % 3 == 0, "title"),
            F.when(F.col("url").contains("?"), "query"),
        ),
        lambda h: h.isNotNull(),
    )
    return profile.header_census(d.table(spark, sf_dir, "pages").select(headers.alias("headers")))


@query(
    "fill_rates",
    """
    SELECT src_file, count(*) AS "rows", round(count(legal_person) * 100 / count(*), 1) AS legal, round(count(e2) * 100 / count(*), 1) AS email2,
           round(count(address) * 100 / count(*), 1) AS address FROM registry_rows GROUP BY src_file""",
    ("registry_rows",),
)
def fill_rates(spark, sf_dir):
    return profile.fill_rates(d.registry_rows(spark, sf_dir), ["legal", "email2", "address"], ["src_file"])


@query(
    "timing_percentiles",
    """
    WITH s AS (SELECT event_type, list_sort(list(value)) AS xs FROM events GROUP BY event_type)
    SELECT event_type, 'p50' AS stat, xs[len(xs) // 2 + 1] AS value FROM s
    UNION ALL SELECT event_type, 'p95', xs[least(CAST(floor(len(xs) * 0.95) AS BIGINT), len(xs) - 1) + 1] FROM s
    UNION ALL SELECT event_type, 'max', xs[len(xs)] FROM s""",
)
def timing_percentiles(spark, sf_dir):
    return exact_percentiles(
        d.table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "max": 1.0}
    )


@query(
    "price_percentiles",
    """
    WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS xs FROM lineitem GROUP BY l_returnflag)
    SELECT l_returnflag, 'p50' AS stat, xs[len(xs) // 2 + 1] AS value FROM s
    UNION ALL SELECT l_returnflag, 'p99', xs[CAST(floor(len(xs) * 0.99) AS BIGINT) + 1] FROM s""",
)
def price_percentiles(spark, sf_dir):
    """Three flags share all line items, so every key is a hot one."""
    priced = d.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return exact_percentiles(priced, ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p99": 0.99})


@query(
    "union_keys",
    """
    SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders UNION SELECT l_suppkey + 1000000 FROM lineitem""",
)
def union_keys(spark, sf_dir):
    return setops.union_keys(
        "k", d.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")),
        d.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")),
        d.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + 1_000_000).alias("k")),
    )


@query(
    "distinct_report",
    "SELECT count(*) AS entries, count(DISTINCT l_orderkey) AS distinct_keys, count(*) - count(DISTINCT l_orderkey) AS duplicates FROM lineitem",
)
def distinct_report(spark, sf_dir):
    return setops.distinct_report(d.table(spark, sf_dir, "lineitem"), "l_orderkey")


@query(
    "key_overlap",
    """
    SELECT count(*) AS right_total, count(t.credit_code) AS matched, round(count(t.credit_code) * 100 / count(*), 2) AS coverage_pct
    FROM (SELECT DISTINCT credit_code FROM contacts) AS c LEFT JOIN (SELECT DISTINCT credit_code FROM tags) AS t ON c.credit_code = t.credit_code""",
    ("contacts", "tags"),
)
def key_overlap(spark, sf_dir):
    return setops.overlap_report(d.tags(spark, sf_dir), d.contacts(spark, sf_dir), "credit_code")


@query(
    "intersect_keys",
    "SELECT user_id AS k FROM events INTERSECT SELECT c_custkey FROM customer",
)
def intersect_keys(spark, sf_dir):
    users = d.table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    return users.intersect(d.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


@query(
    "subtract_keys",
    "SELECT c_custkey AS k FROM customer EXCEPT SELECT user_id FROM events",
)
def subtract_keys(spark, sf_dir):
    customers = d.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return setops.missing_keys(customers, d.table(spark, sf_dir, "events").select(F.col("user_id").alias("k")), "k")


@query(
    "distinct_regions",
    "SELECT DISTINCT province, city FROM companies",
    ("companies",),
)
def distinct_regions(spark, sf_dir):
    return d.companies(spark, sf_dir).select("province", "city").distinct()


# --- keyword postings --------------------------------------------------------------

WORDS_CTE = rf"""
    words AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{WORD}')) AS ws FROM documents),
    idx AS (SELECT doc_id, unnest(ws) AS token FROM words)"""
#: Rows that a query of any words shows.
BEST = 20


def stored_postings(spark, sf_dir):
    """The postings of all documents, written to the shared folder and read back."""
    path = f"{work_dir(spark)}/postings"
    index = build_postings(spread(d.table(spark, sf_dir, "documents")), "doc_id", "text")
    write_postings(index, path, spark.sparkContext.defaultParallelism)
    return spark.read.parquet(path)


@query(
    "postings",
    f"""
    WITH {WORDS_CTE}
    SELECT token, count(*) AS n FROM idx GROUP BY token""",
)
def postings(spark, sf_dir):
    index = build_postings(spread(d.table(spark, sf_dir, "documents")), "doc_id", "text")
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "token_any",
    rf"""
    WITH {WORDS_CTE},
    terms AS (SELECT page_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(url), '{WORD}'))) AS token FROM pages),
    hits AS (SELECT query_id, doc_id, count(*) AS hits FROM terms JOIN idx USING (token) GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, hits FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS rn FROM hits) AS x WHERE rn <= {BEST}""",
)
def token_any(spark, sf_dir):
    """The documents with the most words of a page's address."""
    queries = d.table(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"), F.col("url").alias("query"))
    return best_any(stored_postings(spark, sf_dir), queries, "doc_id", BEST)


@query(
    "token_all",
    rf"""
    WITH {WORDS_CTE},
    queries AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '{WORD}')) AS ws FROM benchmark),
    terms AS (SELECT query_id, len(ws) AS wanted, unnest(ws) AS token FROM queries)
    SELECT query_id, doc_id FROM (SELECT query_id, doc_id, wanted, count(*) AS hits FROM terms JOIN idx USING (token) GROUP BY ALL) AS x WHERE hits = wanted""",
)
def token_all(spark, sf_dir):
    """Which documents contain all words of a benchmark item."""
    queries = d.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return match_all(stored_postings(spark, sf_dir), queries, "doc_id")


# --- streams -------------------------------------------------------------------------


def event_stream(spark, sf_dir):
    schema = d.table(spark, sf_dir, "events").schema
    return increments.file_stream(spark, sf_dir, schema, name_filter="events.parquet")


@query(
    "stream_ingest",
    "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type",
)
def stream_ingest(spark, sf_dir):
    """Run twice on one checkpoint: nothing arrives twice."""
    folder = work_dir(spark)
    for _ in range(2):
        increments.ingest(event_stream(spark, sf_dir), f"{folder}/check", f"{folder}/data").awaitTermination()
    return spark.read.parquet(f"{folder}/data").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids")
    )


@query(
    "stream_upsert",
    """
    SELECT k, label, seq, event_id FROM (SELECT user_id AS k, event_type AS label, CAST(floor(value) AS BIGINT) % 50 AS seq, event_id,
           row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(value) AS BIGINT) % 50 DESC, event_id DESC) AS rn FROM events) AS x WHERE rn = 1""",
)
def stream_upsert(spark, sf_dir):
    folder = work_dir(spark)
    rows = event_stream(spark, sf_dir).select(
        F.col("user_id").alias("k"), F.col("event_type").alias("label"),
        (F.floor("value").cast("long") % 50).alias("seq"), "event_id",
    )
    increments.upsert_stream(rows, f"{folder}/check", f"{folder}/data", ["k"], "seq", ["event_id"]).awaitTermination()
    return increments.read_upserted(spark, f"{folder}/data", ["k"], "seq", ["event_id"])


CHANGES = f"""
    changes AS (SELECT credit_code, contact_type, contact_value, op FROM (
        SELECT *, row_number() OVER (PARTITION BY credit_code, contact_type, contact_value ORDER BY event_id DESC) AS rn FROM (
            SELECT {code('user_id')} AS credit_code, kind AS contact_type, {cvalue('kind', 'event_id % 40')} AS contact_value,
                   CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END AS op, event_id
            FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'landline' ELSE 'email' END AS kind FROM events) AS e) AS c) AS x WHERE rn = 1)"""


@query(
    "stream_flags",
    f"""
    WITH {CHANGES}
    SELECT credit_code, count(*) FILTER (WHERE op = 'add' AND contact_type = 'mobile') AS mobile_count,
           count(*) FILTER (WHERE op = 'add' AND contact_type = 'email') AS email_count,
           CASE WHEN count(*) FILTER (WHERE op = 'add') > 0 THEN 1 ELSE 0 END AS has_contact
    FROM changes GROUP BY credit_code""",
)
def stream_flags(spark, sf_dir):
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "mobile").when(e % 3 == 1, "landline").otherwise("email")
    rows = event_stream(spark, sf_dir).select(
        d.company_code(F.col("user_id")).alias("credit_code"), kind.alias("contact_type"),
        d.contact_value(kind, e % 40).alias("contact_value"),
        F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("op"), "event_id",
    )
    folder = work_dir(spark)
    increments.contact_change_stream(rows, f"{folder}/check", f"{folder}/data", ["event_id"]).awaitTermination()
    flags = increments.current_flags(spark, f"{folder}/data", ["event_id"])
    return flags.select("credit_code", "mobile_count", "email_count", "has_contact")


@query_like("stream_flag_state", "stream_flags")
def stream_flag_state(spark, sf_dir):
    """The flags of ``stream_flags``, kept in the state of the stream."""
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "mobile").when(e % 3 == 1, "landline").otherwise("email")
    rows = event_stream(spark, sf_dir).select(
        d.company_code(F.col("user_id")).alias("credit_code"), kind.alias("contact_type"), d.contact_value(kind, e % 40).alias("contact_value"),
        F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("op"), e.cast("long").alias("at"),
    )
    folder = work_dir(spark)
    increments.flag_stream(rows, f"{folder}/check", f"{folder}/data").awaitTermination()
    return increments.read_flags(spark, f"{folder}/data").select("credit_code", "mobile_count", "email_count", "has_contact")


@query(
    "stream_dedupe",
    "SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events) AS x",
)
def stream_dedupe(spark, sf_dir):
    """Replayed changes of one user, type and day; the whole log is within the delay."""
    keyed = event_stream(spark, sf_dir).withColumns(
        {"day": F.col("ts").cast("date"), "seen_at": F.col("ts").cast("timestamp")}
    )
    once = increments.without_replays(keyed, ["user_id", "event_type", "day"], "seen_at", "60 days")
    folder = work_dir(spark)
    increments.ingest(once, f"{folder}/check", f"{folder}/data").awaitTermination()
    return spark.read.parquet(f"{folder}/data").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")
    )
