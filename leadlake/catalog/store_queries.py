"""Tables on storage: joins of two stores, rewrites of touched folders, labelled loads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadlake.catalog import domain as d
from leadlake.catalog.entry import query, query_like
from leadlake.catalog.load_queries import ENTITY_ROWS, EVENT_ROWS, entity_rows, event_rows
from leadlake.operators import profile, stores
from leadlake.operators.aggregates import valid_certificates
from leadlake.operators.ranking import keep_best, keep_last
from leadlake.plans import load
from leadlake.session import work_dir

BUCKETS, PARTS = 32, 512


@query_like("coverage_two_stores", "certified_coverage")
def coverage_two_stores(spark, sf_dir):
    """Certificates in one database, the registry's tags in another, bucketed alike."""
    path, mark = work_dir(spark), uuid.uuid4().hex[:12]
    for store in ("certificates", "registry"):
        stores.create_store(spark, f"{store}_{mark}", f"{path}/{store}")
    certified = stores.save_bucketed(d.qualifications(spark, sf_dir), f"certificates_{mark}.qualifications", "credit_code", BUCKETS)
    registry = stores.save_bucketed(d.tags(spark, sf_dir).select("credit_code", "company_name"), f"registry_{mark}.companies", "credit_code", BUCKETS)
    return stores.coverage(valid_certificates(certified), registry)


def _entities(spark, sf_dir) -> stores.KeyedTable:
    table = stores.KeyedTable(f"{work_dir(spark)}/entities", ("k",), PARTS)
    table.create(entity_rows(spark, sf_dir))
    return table


@query_like("upsert_touched", "upsert_sequence")
def upsert_touched(spark, sf_dir):
    """The upsert of ``upsert_sequence`` on a stored table: folders without changes stay."""
    table = _entities(spark, sf_dir)
    table.upsert(event_rows(spark, sf_dir), "seq", ["event_id"])
    return table.read(spark)


@query_like("patch_touched", "upsert_partial")
def patch_touched(spark, sf_dir):
    table = _entities(spark, sf_dir)
    patch = keep_last(event_rows(spark, sf_dir), ["k"], ["event_id"]).withColumn("label", F.when(F.col("label") != "error", F.col("label")))
    table.patch(patch, ["label"], "seq")
    return table.read(spark).select("k", "label", "amount", "seq")


@query(
    "upsert_rewritten_parts",
    f"""
    WITH changes AS (SELECT DISTINCT k FROM ({EVENT_ROWS}) AS e WHERE label = 'error'),
    placed AS (SELECT CAST('0x' || substr(md5(CAST(k AS VARCHAR)), 1, 7) AS BIGINT) % {PARTS} AS part, k FROM ({ENTITY_ROWS}) AS t),
    changed AS (SELECT DISTINCT CAST('0x' || substr(md5(CAST(k AS VARCHAR)), 1, 7) AS BIGINT) % {PARTS} AS part FROM changes)
    SELECT CAST(part AS VARCHAR) AS part, max(touched) AS rewritten FROM (
        SELECT part, 0 AS touched FROM placed UNION ALL SELECT part, 1 FROM changed) AS x GROUP BY part""",
)
def upsert_rewritten_parts(spark, sf_dir):
    """Which folders an upsert of the corrections replaced, by their files before and after it."""
    table = _entities(spark, sf_dir)
    before = stores.files_by_part(spark, table.path)
    before.write.parquet(f"{table.path}-before")
    table.upsert(event_rows(spark, sf_dir).filter(F.col("label") == "error"), "seq", ["event_id"])
    spark.catalog.refreshByPath(table.path)
    after = stores.files_by_part(spark, table.path)
    changed = stores.rewritten(spark.read.parquet(f"{table.path}-before"), after).withColumn("rewritten", F.lit(1))
    return after.select("part").distinct().join(changed, "part", "left").select("part", F.coalesce("rewritten", F.lit(0)).alias("rewritten"))


@query_like("slice_rewritten", "slice_refresh")
def slice_rewritten(spark, sf_dir):
    """The refresh of ``slice_refresh`` on a stored table: one folder is replaced."""
    rows = event_rows(spark, sf_dir)
    table = stores.SlicedTable(f"{work_dir(spark)}/events", "label")
    table.create(rows)
    table.refresh(entity_rows(spark, sf_dir), "view")
    whole = table.read(spark, rows.schema)
    return whole.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query(
    "load_observed",
    """
    SELECT count(*) + 0 AS "rows", 0 AS bad_rows, count(DISTINCT credit_code) AS companies, count(DISTINCT credit_code) FILTER (WHERE credit_code LIKE 'N%') AS surrogate,
           count(*) - count(DISTINCT credit_code) AS duplicates
    FROM registry_rows""",
    ("registry_rows",),
)
def load_observed(spark, sf_dir):
    """Figures of a registry load, observed by the write itself."""
    keyed = load.keyed_registry(d.registry_rows(spark, sf_dir), limits=True)
    figures = profile.load_observed(keyed, lambda rows: keep_best(rows, ["credit_code"], "fill_score", ["src_file", "row_no"]), f"{work_dir(spark)}/companies")
    return spark.createDataFrame([figures], ", ".join(f"{name} long" for name in figures))
