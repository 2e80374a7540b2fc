"""Map, distance, division and street queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.catalog import domain as d
from leadlake.catalog import vocabulary as v
from leadlake.catalog.domain_sql import words
from leadlake.catalog.entry import query
from leadlake.operators import aggregates as agg
from leadlake.operators import divisions as div
from leadlake.operators.nearby import count_around, nearest
from leadlake.operators.predicates import CompanyFilter
from leadlake.plans import national, search
from leadlake.schemas import Tables
from leadlake.sources.files import division_schema, flatten_divisions

DISTANCE = (
    "2 * 6371000 * asin(sqrt(power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat))"
    " * power(sin(radians({b}.lng - {a}.lng) / 2), 2)))"
)
TREE_CITY = (
    "CASE WHEN {c}.city LIKE '%直辖%' THEN {c}.district ELSE (" + words(v.TREE_CITIES) + ")[list_position("
    + words(v.CITIES) + ", {c}.city)] END"
)
BOX = (99.95, 23.9, 105.5, 30.0)


def clusters_sql(level, keys, n):
    return f"""
    SELECT * FROM (SELECT {keys}, {level} AS name, count(*) AS cnt, round(CAST(sum(capital_wan) AS DOUBLE) / count(capital_wan), 1) AS metric,
                          round(avg(lng) + 0.0000001234, 6) AS lng, round(avg(lat) + 0.0000001234, 6) AS lat, sum(has_mobile) AS with_mobile
                   FROM companies WHERE status = '存续' AND has_mobile = 1 AND lng IS NOT NULL AND coalesce({level}, '') <> ''
                   GROUP BY {keys} HAVING avg(lng) BETWEEN 99.95 AND 105.5 AND avg(lat) BETWEEN 23.9 AND 30.0) AS x
    ORDER BY cnt DESC, {keys} LIMIT {n}"""


def clusters(spark, sf_dir, zoom):
    found = search.map_clusters(Tables(d.companies(spark, sf_dir)), BOX, zoom)["clusters"]
    # Centres are often exact ties of the sixth digit; both sides step off them.
    return found.withColumns({c: F.round(F.col(c) + 0.0000001234, 6) for c in ("lng", "lat")})


@query("map_clusters_city", clusters_sql("city", "city", 40), ("companies",))
def map_clusters_city(spark, sf_dir):
    return clusters(spark, sf_dir, 9)


@query("map_clusters_district", clusters_sql("district", "city, district", 80), ("companies",))
def map_clusters_district(spark, sf_dir):
    return clusters(spark, sf_dir, 11)


@query("map_clusters_street", clusters_sql("street", "city, district, street", 120), ("companies",))
def map_clusters_street(spark, sf_dir):
    return clusters(spark, sf_dir, 13)


@query(
    "map_view_total",
    """
    SELECT count(*) AS total FROM companies WHERE status = '存续' AND has_mobile = 1
      AND lng BETWEEN 99.95 AND 105.5 AND lat BETWEEN 23.9 AND 30.0""",
    ("companies",),
)
def map_view_total(spark, sf_dir):
    return search.map_clusters(Tables(d.companies(spark, sf_dir)), BOX, 9)["total"]


@query(
    "map_list",
    """
    SELECT c.credit_code, c.company_name, c.has_mobile, coalesce(n, 0) AS shown
    FROM (SELECT * FROM companies WHERE city = '杭州市' AND status IN ('存续', '迁出') ORDER BY has_mobile DESC, capital_wan DESC NULLS LAST, credit_code LIMIT 200) AS c
    LEFT JOIN (SELECT credit_code, least(count(*), 3) AS n FROM contacts WHERE contact_type <> 'email' GROUP BY credit_code) AS k ON k.credit_code = c.credit_code""",
    ("companies", "contacts"),
)
def map_list(spark, sf_dir):
    tables = Tables(d.companies(spark, sf_dir), d.contacts(spark, sf_dir))
    f = CompanyFilter(city="杭州市", status="存续,迁出")
    items = search.map_companies(tables, f, require_geo=False)["items"]
    return items.select("credit_code", "company_name", "has_mobile", F.size("contacts_preview").alias("shown"))


@query(
    "nearby",
    f"""
    WITH here AS (SELECT CAST(101.6 AS DOUBLE) AS lng, CAST(32.4 AS DOUBLE) AS lat),
    near AS (SELECT c.*, {DISTANCE.format(a='here', b='c')} AS m FROM companies AS c, here WHERE c.status = '存续' AND c.has_mobile = 1 AND c.lng IS NOT NULL)
    SELECT n.credit_code, CAST(round(m) AS BIGINT) AS distance_m, CASE WHEN s.credit_code IS NULL THEN '' ELSE 'blocked' END AS contact_flag
    FROM near AS n LEFT JOIN (SELECT DISTINCT credit_code FROM contact_status WHERE user_id = 'u1' AND status IN ('blocked', 'contacted')) AS s ON s.credit_code = n.credit_code
    WHERE m <= 10000 ORDER BY s.credit_code IS NOT NULL, round(m), capital_wan DESC NULLS LAST, n.credit_code LIMIT 100""",
    ("companies", "contact_status"),
)
def nearby(spark, sf_dir):
    tables = Tables(d.companies(spark, sf_dir), contact_status=d.contact_status(spark, sf_dir))
    near = search.nearby(tables, 101.6, 32.4, 10_000, user="u1")
    return near.select("credit_code", "distance_m", "contact_flag")


def supplier_centres(spark, sf_dir):
    """Suppliers as sales offices around the centre of their nation."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    lng, lat = d.city_centre(n)
    return d.table(spark, sf_dir, "supplier").select(
        k.alias("centre_id"), (lng + (k % 11 - 5) / F.lit(100.0)).alias("lng"),
        (lat + (k % 13 - 6) / F.lit(100.0)).alias("lat"), (2000 + k % 5 * 1000).cast("double").alias("radius_m"),
    )


OFFICES = """
    offices AS (SELECT s_suppkey AS centre_id, CAST(100 AS DOUBLE) + s_nationkey * CAST(0.8 AS DOUBLE) + (s_suppkey % 11 - 5) / CAST(100 AS DOUBLE) AS lng,
                       CAST(24 AS DOUBLE) + (s_nationkey * 7 % 25) * CAST(0.6 AS DOUBLE) + (s_suppkey % 13 - 6) / CAST(100 AS DOUBLE) AS lat,
                       2000 + s_suppkey % 5 * 1000 AS radius_m FROM supplier)"""


@query(
    "radius_batch_join",
    f"""
    WITH {OFFICES}
    SELECT o.centre_id, count(c.credit_code) AS n, coalesce(sum(c.has_mobile), 0) AS with_mobile
    FROM offices AS o LEFT JOIN companies AS c ON {DISTANCE.format(a='o', b='c')} <= o.radius_m GROUP BY o.centre_id""",
    ("companies",),
)
def radius_batch_join(spark, sf_dir):
    return count_around(supplier_centres(spark, sf_dir), d.companies(spark, sf_dir))


@query(
    "nearest_companies",
    f"""
    WITH {OFFICES},
    pairs AS (SELECT o.centre_id, c.credit_code, CAST(round({DISTANCE.format(a='o', b='c')}) AS BIGINT) AS distance_m
              FROM offices AS o JOIN companies AS c ON {DISTANCE.format(a='o', b='c')} <= o.radius_m)
    SELECT centre_id, credit_code, distance_m FROM (SELECT *, row_number() OVER (PARTITION BY centre_id ORDER BY distance_m, credit_code) AS rn FROM pairs) AS x WHERE rn <= 5""",
    ("companies",),
)
def nearest_companies(spark, sf_dir):
    found = nearest(supplier_centres(spark, sf_dir), d.companies(spark, sf_dir).select("credit_code", "lng", "lat"), "credit_code", 5)
    return found.select("centre_id", "credit_code", "distance_m")


@query(
    "alias_join",
    f"""
    SELECT c.credit_code, v.row_key FROM companies AS c JOIN divisions AS v
      ON v.level = 'street' AND v.district = c.district AND v.street = c.street AND v.city = {TREE_CITY.format(c='c')}
    WHERE v.center_lng IS NOT NULL""",
    ("companies", "divisions"),
)
def alias_join(spark, sf_dir):
    located = d.divisions(spark, sf_dir).filter(F.col("center_lng").isNotNull())
    joined = div.same_city(d.companies(spark, sf_dir), located, "street", ["district", "street"])
    return joined.select("credit_code", "row_key")


PLACES = f"""
    known AS (SELECT level, city, district, street, center_lng AS lng, center_lat AS lat FROM divisions WHERE center_lng IS NOT NULL AND level IN ('street', 'district')),
    options AS (SELECT * FROM (SELECT c.credit_code, v.level, v.center_lng AS lng, v.center_lat AS lat,
                     row_number() OVER (PARTITION BY c.credit_code, v.level ORDER BY CASE WHEN v.province = c.province THEN 0 ELSE 1 END, v.row_key) AS rn
                FROM companies AS c JOIN divisions AS v ON v.city = {TREE_CITY.format(c='c')} AND v.district = c.district
                     AND (v.level = 'district' OR v.level = 'street' AND v.street = c.street)
                WHERE v.center_lng IS NOT NULL) AS o WHERE rn = 1),
    placed AS (SELECT c.*, coalesce(s.lng, x.lng) AS plng, coalesce(s.lat, x.lat) AS plat,
                      CASE WHEN s.lng IS NOT NULL THEN 'street' WHEN x.lng IS NOT NULL THEN 'district' END AS precision
               FROM companies AS c LEFT JOIN options AS s ON s.level = 'street' AND s.credit_code = c.credit_code
                    LEFT JOIN options AS x ON x.level = 'district' AND x.credit_code = c.credit_code)"""


@query(
    "centre_geocode",
    f"""
    WITH {PLACES},
    seeded AS (SELECT *, CAST('0x' || substr(md5(credit_code), 1, 8) AS BIGINT) AS h FROM placed)
    SELECT credit_code, CASE WHEN lng IS NULL AND status = '存续' THEN precision WHEN lng IS NULL THEN NULL ELSE 'address' END AS geo_precision,
           round(CASE WHEN lng IS NULL AND status = '存续' THEN plng + ((h % 1000) / CAST(999 AS DOUBLE) - CAST(0.5 AS DOUBLE)) * 2 * 120
                 / (CAST(111000 AS DOUBLE) * greatest(cos(radians(plat)), CAST(0.2 AS DOUBLE))) ELSE lng END, 6) AS lng,
           CASE WHEN lng IS NULL AND status = '存续' AND precision IS NOT NULL THEN fill_score + 1 ELSE fill_score END AS fill_score
    FROM seeded""",
    ("companies", "divisions"),
)
def centre_geocode(spark, sf_dir):
    placed = div.geocode(d.companies(spark, sf_dir), d.divisions(spark, sf_dir))
    return placed.select("credit_code", "geo_precision", F.round("lng", 6).alias("lng"), "fill_score")


@query(
    "address_geocode",
    """
    WITH points AS (SELECT city, address, min(lng) AS lng FROM companies WHERE address IS NOT NULL AND lng IS NOT NULL GROUP BY city, address)
    SELECT c.credit_code, CASE WHEN c.lng IS NULL AND c.has_mobile = 1 AND c.status = '存续' AND p.lng IS NOT NULL THEN 'known' WHEN c.lng IS NOT NULL THEN 'address' END AS geo_precision
    FROM companies AS c LEFT JOIN points AS p ON p.city = c.city AND p.address = c.address""",
    ("companies",),
)
def address_geocode(spark, sf_dir):
    """Located companies serve as the table of known addresses."""
    c = d.companies(spark, sf_dir)
    known = c.filter(F.col("lng").isNotNull() & F.col("address").isNotNull()).select(
        "city", "address", "lng", "lat", F.lit("known").alias("precision")
    )
    return div.geocode_by_address(c, known).select("credit_code", "geo_precision")


#: Requests of each kind: as registered, wrong district, unknown city with and without a known district, without
#: district, without street, province alone, city alone, nothing, and nothing that is known.
ASKED = {
    "province": ("province", "province", "province", "province", "province", "province", "province", "", "", "火星省"),
    "city": ("city", "city", "未知市", "未知市", "city", "city", "", "city", "", "未知市"),
    "district": ("district", "无此区", "district", "", "", "district", "", "", "", "无此区"),
    "street": ("street", "street", "street", "", "street", "", "", "", "", "street"),
}


def asked_sql(part):
    forms = " ".join(
        f"WHEN {i} THEN {'coalesce(' + part + ', ' + chr(39) * 2 + ')' if form == part else chr(39) + form + chr(39)}" for i, form in enumerate(ASKED[part])
    )
    return f"CASE kind {forms} END AS {part}"


def hits_sql(rank, zoom, level, condition, later="0"):
    return f"""
    SELECT r.credit_code, r.kind, {rank} AS rank, {later} AS later, v.row_key, v.center_lng, v.center_lat, {zoom} AS zoom, v.province AS fp, v.city AS fc, v.district AS fd, v.street AS fs
    FROM keyed AS r JOIN divisions AS v ON v.level = '{level}' AND v.center_lng IS NOT NULL AND {condition}"""


WITHIN = "r.city <> '' AND v.city = r.tree_city"
BELOW = "r.city <> '' AND r.district <> ''"


@query(
    "admin_center",
    f"""
    WITH asked AS MATERIALIZED (SELECT credit_code, kind, {", ".join(asked_sql(part) for part in ASKED)} FROM companies, range({len(ASKED["city"])}) AS t(kind)),
    keyed AS MATERIALIZED (SELECT *, CASE WHEN r.city LIKE '%直辖%' THEN r.district ELSE ({words(v.TREE_CITIES)})[list_position({words(v.CITIES)}, r.city)] END AS tree_city FROM asked AS r),
    hits AS ({hits_sql(1, 15, "street", f"{WITHIN} AND {BELOW} AND r.street <> '' AND v.district = r.district AND v.street = r.street")}
      UNION ALL {hits_sql(2, 15, "street", f"{WITHIN} AND {BELOW} AND r.street <> '' AND v.street = r.street")}
      UNION ALL {hits_sql(3, 13, "district", f"{WITHIN} AND {BELOW} AND v.district = r.district")}
      UNION ALL {hits_sql(4, 13, "district", f"{BELOW} AND r.province <> '' AND v.province = r.province AND v.district = r.district")}
      UNION ALL {hits_sql(5, 11, "city", WITHIN)}
      UNION ALL {hits_sql(6, 11, "city", "r.city <> '' AND r.province <> '' AND v.province = r.province", "CASE WHEN v.city LIKE '%城区%' THEN 0 ELSE 1 END")}
      UNION ALL {hits_sql(7, 8, "province", "r.province <> '' AND v.province = r.province")}),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY credit_code, kind ORDER BY rank, later, row_key, fp, fc, fd, fs) AS rn FROM hits) AS x WHERE rn = 1)
    SELECT r.credit_code, r.kind, CASE WHEN b.rn = 1 THEN 1 ELSE 0 END AS found,
           coalesce(b.zoom, CASE WHEN r.province <> '' THEN 8 WHEN r.city <> '' THEN 11 ELSE 10 END) AS zoom,
           round(b.center_lng, 6) AS lng, round(b.center_lat, 6) AS lat,
           coalesce(nullif(r.street, ''), nullif(r.district, ''), nullif(r.city, ''), r.province) AS name,
           coalesce(nullif(b.fp, ''), r.province) AS found_province, coalesce(nullif(CASE WHEN rank < 7 THEN b.fc END, ''), r.city) AS found_city,
           coalesce(nullif(CASE WHEN rank < 5 THEN b.fd END, ''), r.district) AS found_district,
           coalesce(nullif(CASE WHEN rank < 3 THEN b.fs END, ''), r.street) AS found_street
    FROM keyed AS r LEFT JOIN best AS b ON b.credit_code = r.credit_code AND b.kind = r.kind""",
    ("companies", "divisions"),
)
def admin_center(spark, sf_dir):
    form = lambda part, i: F.coalesce(F.col(part), F.lit("")) if ASKED[part][i] == part else F.lit(ASKED[part][i])
    kinds = [F.struct(F.lit(i).alias("kind"), *[form(part, i).alias(part) for part in ASKED]) for i in range(len(ASKED["city"]))]
    # Companies are few rows to move, but ten requests each: all cores take part, however few tasks the scan has.
    c = d.companies(spark, sf_dir).select("credit_code", *ASKED).repartition(4 * spark.sparkContext.defaultParallelism)
    asked = c.select("credit_code", F.explode(F.array(*kinds)).alias("r")).select("credit_code", "r.*")
    return div.admin_centres(asked, d.divisions(spark, sf_dir)).select(
        "credit_code", "kind", F.col("ok").cast("int").alias("found"), "zoom", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"),
        "name", *[f"found_{part}" for part in div.REQUEST],
    )


STREET_MATCH = f"""
    WITH places AS (SELECT DISTINCT province, city, district FROM companies),
    names AS (SELECT DISTINCT p.province, p.city, p.district, v.street AS official FROM places AS p JOIN divisions AS v ON v.level = 'street' AND v.district = p.district
              AND v.city = {TREE_CITY.format(c='p')}),
    also AS (SELECT DISTINCT p.province, p.city, p.district, v.street AS official FROM places AS p JOIN divisions AS v ON v.level = 'street' AND v.district = p.district),
    based AS (SELECT *, regexp_replace(official, '(街道办事处|街道|镇|乡|苏木)$', '') AS base FROM names),
    based2 AS (SELECT *, regexp_replace(official, '(街道办事处|街道|镇|乡|苏木)$', '') AS base FROM also),
    bases AS (SELECT province, city, district, base, arg_max(official, [lpad(CAST(length(official) AS VARCHAR), 3, '0'), official]) AS official,
                     min([lpad(CAST(100 - length(official) AS VARCHAR), 3, '0'), official]) AS head FROM based GROUP BY ALL),
    bases2 AS (SELECT province, city, district, base, arg_max(official, [lpad(CAST(length(official) AS VARCHAR), 3, '0'), official]) AS official,
                     min([lpad(CAST(100 - length(official) AS VARCHAR), 3, '0'), official]) AS head FROM based2 GROUP BY ALL),
    kinds(kind, suffix) AS (VALUES (1, '镇'), (2, '乡'), (3, '街道'), (4, '街道办事处'), (5, '苏木')),
    patterns AS (
        SELECT province, city, district, official AS pattern, official, 0 AS keyno, 0 AS kind, [lpad(CAST(100 - length(official) AS VARCHAR), 3, '0'), official] AS head FROM names
        UNION ALL SELECT province, city, district, base || suffix, official, 0, kind, head FROM bases, kinds WHERE base || suffix <> official
        UNION ALL SELECT province, city, district, official, official, 1, 0, [lpad(CAST(100 - length(official) AS VARCHAR), 3, '0'), official] FROM also
        UNION ALL SELECT province, city, district, base || suffix, official, 1, kind, head FROM bases2, kinds WHERE base || suffix <> official),
    bodies AS (SELECT credit_code, province, city, district,
                      regexp_replace(CASE WHEN contains(substr(b, 1, 12), '高新区') AND strpos(b, '高新区') <= 9 THEN substr(b, strpos(b, '高新区') + 3) ELSE b END, '^[·，,、. ]+', '') AS body
               FROM (SELECT *, CASE WHEN starts_with(a3, district) THEN regexp_replace(substr(a3, length(district) + 1), '^[·，,、. ]+', '') ELSE a3 END AS b
                     FROM (SELECT *, CASE WHEN starts_with(a2, city) THEN substr(a2, length(city) + 1) ELSE a2 END AS a3
                           FROM (SELECT *, CASE WHEN starts_with(coalesce(address, ''), province) THEN substr(address, length(province) + 1) ELSE coalesce(address, '') END AS a2 FROM companies) AS q) AS r) AS s),
    hits AS (SELECT b.credit_code, p.official, p.keyno, p.kind, p.head FROM bodies AS b JOIN patterns AS p ON p.province = b.province AND p.city = b.city AND p.district = b.district
             WHERE strpos(b.body, p.pattern) = 1 OR (strpos(b.body, p.pattern) BETWEEN 2 AND 29
                   AND regexp_matches(substr(b.body, strpos(b.body, p.pattern) + length(p.pattern)), '^($|[零一二三四五六七八九十百千万号弄巷村组队楼栋室层东南北中路街道]|办事处|[^\\x{{4e00}}-\\x{{9fff}}])'))),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY credit_code ORDER BY keyno, kind, head) AS rn FROM hits) AS x WHERE rn = 1)"""


@query(
    "street_match",
    STREET_MATCH + """
    SELECT c.credit_code, coalesce(b.official, '') AS matched_street FROM companies AS c LEFT JOIN best AS b ON b.credit_code = c.credit_code""",
    ("companies", "divisions"),
)
def street_match(spark, sf_dir):
    return div.match_streets(d.companies(spark, sf_dir), d.divisions(spark, sf_dir)).select(
        "credit_code", "matched_street"
    )


@query(
    "street_backfill",
    STREET_MATCH + """
    SELECT c.credit_code, CASE WHEN c.province IN ('浙江省', '河南省', '北京市') AND coalesce(c.street, '') = '' THEN b.official ELSE c.street END AS street,
           c.fill_score + CASE WHEN c.province IN ('浙江省', '河南省', '北京市') AND coalesce(c.street, '') = '' THEN 1 ELSE 0 END AS fill_score
    FROM companies AS c LEFT JOIN best AS b ON b.credit_code = c.credit_code""",
    ("companies", "divisions"),
)
def street_backfill(spark, sf_dir):
    filled = div.backfill_streets(
        d.companies(spark, sf_dir), d.divisions(spark, sf_dir), ("浙江省", "河南省", "北京市"), only_empty=True
    )
    return filled.select("credit_code", "street", "fill_score")


@query(
    "municipality_repair",
    STREET_MATCH.replace("WITH places", f"WITH {PLACES},\n    places", 1) + """
    SELECT p.credit_code,
           CASE WHEN p.province IN ('上海市', '北京市', '天津市', '重庆市') AND coalesce(p.street, '') = '' THEN b.official ELSE p.street END AS street,
           CASE WHEN p.lng IS NOT NULL THEN 'address' WHEN p.status = '存续' AND p.province IN ('上海市', '北京市', '天津市', '重庆市')
                THEN coalesce(p.precision, k.level) END AS geo_precision
    FROM placed AS p LEFT JOIN best AS b ON b.credit_code = p.credit_code
         LEFT JOIN known AS k ON k.level = 'street' AND k.district = p.district AND k.street = b.official AND coalesce(p.street, '') = ''
              AND p.province IN ('上海市', '北京市', '天津市', '重庆市')
              AND k.city = """ + TREE_CITY.format(c="p"),
    ("companies", "divisions"),
)
def municipality_repair(spark, sf_dir):
    repaired = national.repair_municipalities(d.companies(spark, sf_dir), d.divisions(spark, sf_dir))
    return repaired.select("credit_code", "street", "geo_precision")


@query(
    "national_load",
)
def national_load(spark, sf_dir):
    """The whole chain: raw rows, best row, street, centre point."""
    loaded = national.load_national(d.registry_rows(spark, sf_dir), d.divisions(spark, sf_dir), d.as_of(), ["src_file", "row_no"], limits=True)
    return loaded.select("credit_code", "status", "street", "geo_precision", F.round("lng", 5).alias("lng"), "fill_score")


@query(
    "flatten_divisions",
    """
    WITH t AS (SELECT s_suppkey AS k, CAST(s_nationkey AS VARCHAR) AS n FROM supplier)
    SELECT 'province|' || n || '||P' || n AS row_key, 'province' AS level, 'P' || n AS province, '' AS city, '' AS district, '' AS street, '' AS parent_adcode, CAST(k AS DOUBLE) AS center_lng FROM t
    UNION ALL SELECT 'city|c' || n || '|' || n || '|C' || n, 'city', 'P' || n, 'C' || n, '', '', n, NULL FROM t
    UNION ALL SELECT 'district|d' || CAST(i AS VARCHAR) || '|c' || n || '|D' || CAST(i AS VARCHAR), 'district', 'P' || n, 'C' || n, 'D' || CAST(i AS VARCHAR), '', 'c' || n, i + 0.5 FROM t, range(2) AS r(i)
    UNION ALL SELECT 'street|s' || CAST(k AS VARCHAR) || '|d' || CAST(i AS VARCHAR) || '|S' || CAST(k AS VARCHAR), 'street', 'P' || n, 'C' || n, 'D' || CAST(i AS VARCHAR), 'S' || CAST(k AS VARCHAR), 'd' || CAST(i AS VARCHAR), 1.25 FROM t, range(2) AS r(i)""",
)
def flatten_divisions_query(spark, sf_dir):
    """One small division tree per supplier, as the text of a division file."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")

    def node(level, name, adcode, centre, *children):
        body = F.concat(
            F.lit(f'{{"level":"{level}","name":"'), name, F.lit('","adcode":"'), adcode,
            F.lit('","center":"'), centre, F.lit('","districts":['), F.concat_ws(",", *children), F.lit("]}"),
        )
        return body

    def street(i):
        return node("street", F.concat(F.lit("S"), k), F.concat(F.lit("s"), k), F.lit("1.25,2"))

    districts = [
        node("district", F.lit(f"D{i}"), F.lit(f"d{i}"), F.lit(f"{i}.5,3"), street(i)) for i in range(2)
    ]
    tree = node(
        "province", F.concat(F.lit("P"), n), n, F.concat(k, F.lit(",1")),
        node("city", F.concat(F.lit("C"), n), F.concat(F.lit("c"), n), F.lit("bad"), *districts),
    )
    nodes = d.table(spark, sf_dir, "supplier").select(F.from_json(tree, division_schema()).alias("node"))
    return flatten_divisions(nodes).select(
        "row_key", "level", "province", "city", "district", "street", "parent_adcode", "center_lng"
    )


@query(
    "division_levels",
    """
    SELECT level, count(*) AS n, count(center_lng) AS located, count(DISTINCT province) AS provinces FROM divisions GROUP BY level""",
    ("divisions",),
)
def division_levels(spark, sf_dir):
    return agg.division_levels(d.divisions(spark, sf_dir))
