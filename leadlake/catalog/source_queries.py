"""Loads from files that Spark writes from the given tables and reads back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.catalog import domain as d
from leadlake.catalog import vocabulary as v
from leadlake.catalog.domain_sql import code, mobile, name, pick
from leadlake.catalog.entry import query, query_like
from leadlake.functions.text import clean
from leadlake.plans import load
from leadlake.session import work_dir
from leadlake.sources import files, headers, workbooks

ROW = "行号"


def named(mapping: dict[str, str], df: DataFrame, *fields: str) -> DataFrame:
    """Fields under the header they have in files; the row number under one of its own."""
    heads = {f: h for h, f in reversed(mapping.items())} | {"row_no": ROW}
    return df.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(heads[f]) for f in fields])


def numbered(mapping: dict[str, str]) -> dict[str, str]:
    return {**mapping, ROW: "row_no"}


# --- headed and positional text files ------------------------------------------------

REGISTRY_FIELDS = (
    "name", "credit", "status", "legal", "scale", "capital", "established", "province", "city", "district", "ind1", "insured",
    "mobile", "landline", "email", "email2", "address", "scope", "row_no",
)


@query(
    "registry_files",
    f"""
    SELECT credit_code, company_name, status, legal_person, CAST(capital_wan AS DOUBLE) AS capital_wan, CAST(established AS VARCHAR) AS established,
           province, city, district, insured_count, address, fill_score, CASE WHEN e2 IS NULL THEN 1 ELSE 2 END AS email_count
    FROM (SELECT *, row_number() OVER (PARTITION BY credit_code ORDER BY fill_score DESC, row_no) AS rn FROM registry_rows) AS x WHERE rn = 1""",
    ("registry_rows",),
)
def registry_files(spark, sf_dir):
    """Headed files in one folder per province; the folder fills in the province."""
    path, rows = f"{work_dir(spark)}/registry", d.registry_rows(spark, sf_dir)
    heads = named(headers.REGISTRY, rows.select("*"), *REGISTRY_FIELDS).columns
    out = rows.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(h) for f, h in zip(REGISTRY_FIELDS, heads, strict=True)], "src_group")
    out.write.options(header=True, escape='"').partitionBy("src_group").csv(path)
    read = files.read_registry(spark, f"{path}/*", numbered(headers.REGISTRY)).withColumn("row_no", F.col("row_no").cast("long"))
    made = load.registry_companies(load.keyed_registry(read, limits=True), d.as_of(), ["row_no"], limits=True)
    return made.select(
        "credit_code", "company_name", "status", "legal_person", "capital_wan", "established", "province", "city", "district", "insured_count",
        "address", "fill_score", "email_count",
    )


@query_like("monthly_files", "monthly_fold")
def monthly_files(spark, sf_dir):
    """Files without header, fields by position."""
    path, o, c = f"{work_dir(spark)}/monthly", F.col("o_orderkey"), F.col("o_custkey")
    credit = F.when(c % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("91"), F.lpad(c.cast("string"), 16, "0")))
    cells = (
        d.company_name(c), F.when(o % 2 == 0, "王伟").otherwise("-"), F.col("o_orderdate").cast("date").cast("string"), F.lit("宝山区某路"), F.lit("企业"),
        credit, F.lit("100万元"), F.lit("制造业"), F.lit("上海-宝山区"), F.lit("销售"), d.contact_value(F.lit("mobile"), o % 97), o.cast("string"),
    )
    fields = (*headers.MONTHLY, "row_no")
    d.table(spark, sf_dir, "orders").select(*[x.alias(f) for x, f in zip(cells, fields, strict=True)]).write.options(escape='"').csv(path)
    rows = files.read_positional(spark, path, fields).fillna("").withColumn("row_no", F.col("row_no").cast("long"))
    return load.monthly_companies(rows, d.as_of(), ["row_no"], limits=True).select(
        "credit_code", "established", "fill_score", "mobile_count", "has_mobile", "has_email", "legal_person", "city", "district",
    )


def certificate_csv(spark: SparkSession, sf_dir: str) -> str:
    """Certificate files of all companies; every ninth customer has no code."""
    path, k = f"{work_dir(spark)}/certificates", F.col("c_custkey")
    rows = d.table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" "), d.company_name(k)).alias("name"),
        F.when(k % 9 == 0, F.lit("无")).otherwise(F.concat(F.lit("91"), F.lpad(k.cast("string"), 16, "0"))).alias("credit"),
        d.pick(v.PROVINCES, F.col("c_nationkey")).alias("province"), d.pick(v.CITIES, F.col("c_nationkey")).alias("city"),
        d.contact_value(F.lit("mobile"), k).alias("phone"), F.concat(F.lit("a,\"b\"\n"), k.cast("string")).alias("address"),
    )
    named(headers.CERTIFICATE_CSV, rows, *rows.columns).write.options(header=True, escape='"').csv(path)
    return path


@query(
    "certificate_files",
    f"""
    SELECT {name('c_custkey')} AS name, '91' || lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS credit, {pick(v.PROVINCES, 'c_nationkey')} AS province,
           {pick(v.CITIES, 'c_nationkey')} AS city, {mobile('c_custkey')} AS phone, 'a,"b"' || chr(10) || CAST(c_custkey AS VARCHAR) AS address
    FROM customer WHERE c_custkey % 9 <> 0""",
)
def certificate_files(spark, sf_dir):
    usable, _ = files.split_rejects(files.read_certificate_csv(spark, certificate_csv(spark, sf_dir)))
    return usable.select(clean(F.col("name")).alias("name"), "credit", "province", "city", "phone", "address")


@query(
    "certificate_rejects",
    f"""
    SELECT {name('c_custkey')} AS name, {pick(v.PROVINCES, 'c_nationkey')} AS province, 'credit_not_18' AS reason, count(*) AS n
    FROM customer WHERE c_custkey % 9 = 0 GROUP BY ALL""",
)
def certificate_rejects(spark, sf_dir):
    """Rows that can't be taken, written to their sink and read back."""
    path = f"{work_dir(spark)}/rejects"
    _, rejects = files.split_rejects(files.read_certificate_csv(spark, certificate_csv(spark, sf_dir)))
    files.write_rejects(rejects, path)
    read = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    return read.groupBy(clean(F.col("name")).alias("name"), "province", "reason").agg(F.count("*").alias("n"))


# --- workbooks whose sheets differ ------------------------------------------------------


def sheet(df: DataFrame, group: str, file: Column, section: str, **cells: Column) -> tuple[DataFrame, dict[str, Column]]:
    """Rows of a section without their header, and the header of the section."""
    values = F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cells.values()])
    rows = df.select(F.lit(group).alias("src_group"), file.alias("src_file"), F.lit(section).alias("section"), values.alias("cells"))
    return rows, {section: F.array(*[F.lit(h) for h in cells])}


def written(spark: SparkSession, path: str, *sheets: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """Workbooks of the sheets, one task per file, read back in blocks of rows. Rows get their header where they are written."""
    workbooks.register(spark)
    rows = reduce(DataFrame.unionByName, [r for r, _ in sheets])
    whole = rows.repartition("src_group", "src_file").sortWithinPartitions("src_group", "src_file", "section")
    header = F.coalesce(*[F.when(F.col("section") == section, head) for _, heads in sheets for section, head in heads.items()])
    whole.withColumn("header", header).write.format(workbooks.FORMAT).mode("append").save(path)
    return spark.read.format(workbooks.FORMAT).option("blocks", True).load(path)


def month(day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM"), F.lit(".xlsx"))


def chain_workbooks(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A workbook a month with the chain rows, a base sheet with columns of one meaning, and sheets to be left out; in branches."""
    r, o = d.chain_rows(spark, sf_dir), d.table(spark, sf_dir, "orders")
    key, c = F.col("o_orderkey"), F.col("o_custkey")
    chain = sheet(
        r, "产业链", month(F.col("src_file").cast("date")), "产业链",
        **{"一级分类": F.col("l1"), "二级分类": F.col("l2"), " 三级分类 ": F.col("l3"), "公司名称": F.col("name"), "统一社会信用代码": F.col("credit"),
           "产业链节点": F.col("node"), "产业位置": F.col("position"), "产业关联性": F.col("relatedness"), "融资上市": F.col("financing"),
           "荣誉": F.col("honors"), "备注": F.col("src_file"), ROW: F.col("row_no")},
    )
    base = sheet(
        o, "产业链", month(F.col("o_orderdate")), "基础信息",
        **{"公司名称": d.company_name(c), "登记状态": d.pick(v.STATUS_RAW, c * 3 % 8), "注册资本": F.lit("100万元"), "不可用电话": F.lit("19999999999"),
           "可用电话": d.contact_value(F.lit("mobile"), key), "电话": d.contact_value(F.lit("mobile"), key + 1),
           "统一社会信用代码": F.concat(F.lit("91"), F.lpad(c.cast("string"), 16, "0")), ROW: key},
    )
    other = sheet(o.filter(key % 32 == 1), "产业链", month(F.col("o_orderdate")), "Sheet3", 说明=F.lit("x"))
    path = work_dir(spark)
    return files.staged_sections(written(spark, f"{path}/books", chain, base, other), f"{path}/staged")


@query_like("chain_workbook_tags", "chain_tag_merge")
def chain_workbook_tags(spark, sf_dir):
    rows = files.section_fields(chain_workbooks(spark, sf_dir)["chain"], {**numbered(headers.CHAIN), "备注": "src_file"}).drop("src_group")
    merged = load.merge_tags(d.tags(spark, sf_dir), load.chain_tag_rows(rows.withColumn("row_no", F.col("row_no").cast("long")), limits=True), ["src_file", "row_no"])
    return merged.select(
        "credit_code", F.col("chain_industries").alias("industries"), "chain_nodes", "honors", "chain_positions", "relatedness", "tag_finance", "lead_score",
    )


@query(
    "workbook_base",
    f"""
    SELECT o_orderkey AS row_no, {name('o_custkey')} AS name, '91' || lpad(CAST(o_custkey AS VARCHAR), 16, '0') AS credit,
           {pick(v.STATUS_RAW, 'o_custkey * 3 % 8')} AS status, '100万元' AS capital, {mobile('o_orderkey')} AS mobile, '' AS landline,
           strftime(o_orderdate, '%Y-%m') || '.xlsx' AS src_file, '产业链' AS src_group
    FROM orders""",
)
def workbook_base(spark, sf_dir):
    """Base sheets: the first of two phone columns counts, the unusable one is skipped."""
    rows = files.section_fields(chain_workbooks(spark, sf_dir)["base"], numbered(headers.CHAIN_BASE))
    return rows.select(F.col("row_no").cast("long").alias("row_no"), "name", "credit", "status", "capital", "mobile", "landline", "src_file", "src_group")


@query(
    "workbook_rejects",
    """
    SELECT strftime(l_shipdate, '%Y-%m') || '.xlsx' AS src_file, 'credit_not_18' AS reason, count(*) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_custkey % 9 = 0 GROUP BY ALL""",
)
def workbook_rejects(spark, sf_dir):
    """Chain rows without a code, from the same pass that routes the others."""
    return chain_workbooks(spark, sf_dir)["reject"].groupBy("src_file", "reason").agg(F.count("*").alias("n"))


@query(
    "certificate_workbooks",
    f"""
    WITH lines AS (SELECT {code('o_custkey')} AS credit_code, l_linenumber AS line, year(l_shipdate) AS y, CAST(l_shipdate AS DATE) AS d,
                          CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS revoked, l_orderkey AS o, l_partkey AS p, l_suppkey AS s
                   FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 9 <> 0),
         named AS (SELECT *, CASE WHEN line % 2 = 0 THEN 'GR' || CAST(p % 50 AS VARCHAR) ELSE 'HT-' || CAST(y AS VARCHAR) || '-' || right(credit_code, 8) END AS cert_no FROM lines)
    SELECT cert_no, credit_code, CAST(y AS VARCHAR) AS cert_year, CAST(d AS VARCHAR) AS valid_to, revoked FROM (
        SELECT *, row_number() OVER (PARTITION BY credit_code, cert_no ORDER BY y DESC, o DESC, line DESC, p DESC, s DESC, d DESC) AS rn FROM named) AS x
    WHERE rn = 1""",
)
def certificate_workbooks(spark, sf_dir):
    """Certificate lists of each year and month; of equal certificates the one of the latest year's list stays."""
    lines = d.table(spark, sf_dir, "lineitem").join(d.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    c, day = F.col("o_custkey"), F.col("l_shipdate").cast("date")
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = sheet(
        lines, "名单", F.concat(F.date_format(day, "yyyy-MM"), F.lit("认定名单.xlsx")), "名单",
        **{"公司名称": d.company_name(c), "统一信用代码": F.when(c % 9 == 0, "无").otherwise(F.concat(F.lit("91"), F.lpad(c.cast("string"), 16, "0"))),
           "证书编号": F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("GR"), (F.col("l_partkey") % 50).cast("string"))),
           "认定年度": F.year(day), "证书有效期": F.concat(F.lit("至"), F.date_format(day, "yyyy年MM月dd日")),
           "是否取消资格": F.when(F.col("l_returnflag") == "N", "否").otherwise("是"), **{o: F.col(o) for o in order}, "day": day},
    )
    read = written(spark, f"{work_dir(spark)}/books", rows)
    fields = files.section_fields(read, {**headers.CERTIFICATE_TABLE, **{o: o for o in order}, "day": "day"}).filter("row_no > 0")
    typed = fields.withColumns({"list_year": F.substring("src_file", 1, 4), **{o: F.col(o).cast("long") for o in order}, "day": F.col("day").cast("date")})
    return load.certificates(typed, "table", ["list_year", *order, "day"], limits=True).select("cert_no", "credit_code", "cert_year", "valid_to", "revoked")


# --- tables of existing tags ------------------------------------------------------------

ONE, TWO = pick(v.CHAINS, "c_custkey % 10"), pick(v.CHAINS, "(c_custkey // 10) % 10")


@query(
    "tag_table_load",
    f"""
    SELECT {code('c_custkey')} AS credit_code,
           CASE c_custkey % 6 WHEN 0 THEN {ONE} || '|' || {TWO} WHEN 1 THEN {ONE} || '|' || {TWO} WHEN 2 THEN {ONE} WHEN 3 THEN '[x' || {ONE}
                WHEN 4 THEN CAST(c_custkey AS VARCHAR) || '|' || {ONE} END AS chain_industries,
           CASE WHEN c_custkey % 2 = 0 THEN {ONE} || '|' || {TWO} END AS honors,
           CASE WHEN c_custkey % 6 = 3 THEN '[x' || {ONE} END AS rescued, {pick(v.POSITION_TEXTS, 'c_custkey % 3')} AS chain_positions,
           CASE WHEN c_custkey % 5 > 0 THEN {pick(v.FINANCINGS, 'c_custkey % 5')} END AS financing_raw,
           CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 100 END AS lead_score
    FROM customer""",
)
def tag_table_load(spark, sf_dir):
    """A tag table whose lists are JSON, packed text, one value, broken JSON, mixed JSON or nothing."""
    path, k = f"{work_dir(spark)}/tags", F.col("c_custkey")
    one, two = d.pick(v.CHAINS, k % 10), d.pick(v.CHAINS, F.floor(k / 10) % 10)
    both = F.to_json(F.array(one, two))
    industries = (
        F.when(k % 6 == 0, both).when(k % 6 == 1, F.concat_ws(" | ", one, two)).when(k % 6 == 2, one).when(k % 6 == 3, F.concat(F.lit("[x"), one))
        .when(k % 6 == 4, F.concat(F.lit("["), k.cast("string"), F.lit(', null, " '), one, F.lit(' "]'))).otherwise("")
    )
    d.table(spark, sf_dir, "customer").select(
        d.company_code(k).alias("credit_code"), industries.alias("chain_industries"), F.when(k % 2 == 0, both).alias("honors"),
        d.pick(v.POSITION_TEXTS, k % 3).alias("chain_position"), F.when(k % 5 > 0, d.pick(v.FINANCINGS, k % 5)).alias("financing"),
        F.when(k % 7 > 0, (k % 100).cast("string")).otherwise("n/a").alias("lead_score"),
    ).write.options(header=True, escape='"').csv(path)
    made = files.read_tag_table(spark.read.options(header=True, escape='"').csv(path))
    return made.select(
        "credit_code", "chain_industries", "honors", F.element_at("rescued", "chain_industries").alias("rescued"), "chain_positions", "financing_raw", "lead_score",
    )
