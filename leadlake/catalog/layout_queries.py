"""Queries over stored layouts: cells of the map, ranges of pages, counts kept up to date."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.catalog import domain as d
from leadlake.catalog.domain_sql import words
from leadlake.catalog.entry import query, query_like
from leadlake.catalog.geo_queries import BOX
from leadlake.fixed_values import INDUSTRY_SECTIONS, PROVINCES
from leadlake.operators import aggregates as agg
from leadlake.operators import layouts
from leadlake.operators.nearby import reach_box
from leadlake.plans import search
from leadlake.schemas import Tables
from leadlake.session import work_dir

FILES, RANGES, PAGE = 16, 64, 25


def spatial_companies(spark, sf_dir, box):
    path = f"{work_dir(spark)}/companies"
    layouts.write_spatial(d.companies(spark, sf_dir), path, FILES)
    return layouts.in_box_cells(spark.read.parquet(path), box)


@query_like("nearby_spatial", "nearby")
def nearby_spatial(spark, sf_dir):
    """The search of ``nearby`` on companies stored by cell."""
    found = spatial_companies(spark, sf_dir, reach_box(101.6, 32.4, 10_000))
    near = search.nearby(Tables(found, contact_status=d.contact_status(spark, sf_dir)), 101.6, 32.4, 10_000, user="u1")
    return near.select("credit_code", "distance_m", "contact_flag")


@query_like("map_view_spatial", "map_view_total")
def map_view_spatial(spark, sf_dir):
    return search.map_clusters(Tables(spatial_companies(spark, sf_dir, BOX)), BOX, 9)["total"]


@query(
    "deep_page",
    f"""
    SELECT credit_code, CAST(capital_wan AS DOUBLE) AS capital_wan, place FROM (
        SELECT credit_code, capital_wan, row_number() OVER (ORDER BY capital_wan DESC NULLS LAST, credit_code) - 1 AS place, count(*) OVER () // {PAGE} // 2 AS number FROM companies) AS x
    WHERE place // {PAGE} = number""",
    ("companies",),
)
def deep_page(spark, sf_dir):
    """The page in the middle of all companies by capital: one or two ranges are read."""
    rows = d.companies(spark, sf_dir).select("credit_code", "capital_wan")
    table = layouts.PagedTable(f"{work_dir(spark)}/by-capital", (F.desc_nulls_last("capital_wan"), F.asc("credit_code")))
    table.create(rows, RANGES)
    number = table.total(spark).first()["total"] // PAGE // 2
    found = table.page(spark, number + 1, PAGE)
    # At most a page of rows: their places follow from the number of the page.
    shown = [(r["credit_code"], r["capital_wan"], number * PAGE + i) for i, r in enumerate(found.collect())]
    return spark.createDataFrame(shown, "credit_code string, capital_wan decimal(20,2), place long")


CHANGED = "CASE WHEN k IN (SELECT user_id FROM events WHERE event_type = 'error') THEN {new} ELSE {old} END"


@query(
    "facets_maintained",
    f"""
    WITH changed AS (SELECT province, industry_l1, {CHANGED.format(new="'大型'", old="scale")} AS scale, {CHANGED.format(new="'注销'", old="status")} AS status FROM companies)
    SELECT 'province' AS dim, province AS k, count(*) AS n FROM changed WHERE list_contains({words(PROVINCES)}, province) GROUP BY province
    UNION ALL SELECT 'industry', industry_l1, count(*) FROM changed WHERE list_contains({words(INDUSTRY_SECTIONS)}, industry_l1) GROUP BY industry_l1
    UNION ALL SELECT 'scale', scale, count(*) FROM changed WHERE scale IS NOT NULL GROUP BY scale
    UNION ALL SELECT 'status', status, count(*) FROM changed WHERE status IS NOT NULL GROUP BY status""",
    ("companies",),
)
def facets_maintained(spark, sf_dir):
    """Facet counts stored before a batch of changes, brought up to date by the changed rows alone."""
    companies, path = d.companies(spark, sf_dir), f"{work_dir(spark)}/facets"
    agg.company_facets(companies).write.parquet(path)
    wrong = d.table(spark, sf_dir, "events").filter("event_type = 'error'").select(d.company_code(F.col("user_id")).alias("credit_code")).distinct()
    before = companies.join(wrong, "credit_code", "left_semi")
    after = before.withColumns({"scale": F.lit("大型"), "status": F.lit("注销")})
    return layouts.changed_counts(spark.read.parquet(path), ["dim", "k"], agg.company_facets(before), agg.company_facets(after))
