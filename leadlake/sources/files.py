"""Reading source files into tables of text columns with internal names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.fixed_values import (
    HONOR_HEADERS,
    HONOR_SECTIONS,
    OTHER_HONOR_SECTIONS,
    SECTION_STATUS_WORDS,
)
from leadlake.functions.identity import is_credit_code, normal_code
from leadlake.functions.tags import unpack
from leadlake.functions.text import clean, is_empty, strip
from leadlake.sources import headers

SOURCE_COLUMNS = ["src_group", "src_file"]


def with_source(df: DataFrame) -> DataFrame:
    """Add the folder and file name each row came from; of a folder ``key=value``, the value."""
    path = F.split(F.col("_metadata.file_path"), "/")
    folder = F.regexp_replace(F.try_element_at(path, F.lit(-2)), "^[^=]+=", "")
    return df.select(
        "*",
        F.coalesce(F.try_url_decode(folder), folder).alias("src_group"),
        F.coalesce(F.try_url_decode("_metadata.file_name"), F.col("_metadata.file_name")).alias("src_file"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Rows of a source scan over at least as many tasks as there are cores.

    Quoted multi-line files cannot be split; when there are fewer of them than
    cores, their rows are redistributed before the costly cleaning.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def new_files(spark: SparkSession, path: str, ledger: DataFrame) -> DataFrame:
    """(file_key, path) of files not in the ledger of loaded ones.

    The key is folder, name and size, so a changed file counts as new. The batch
    counterpart of the file stream, for loads that keep their own ledger.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    key = F.concat_ws("__", F.element_at(parts, -2), F.element_at(parts, -1), F.col("length").cast("string"))
    return found.select(key.alias("file_key"), "path").join(ledger.select("file_key"), "file_key", "left_anti")


def map_headers(df: DataFrame, mapping: Mapping[str, str], required: Iterable[str]) -> DataFrame:
    """Rename headed columns to fields. The first column of a field wins; a
    table without a required field is refused."""
    chosen: dict[str, str] = {}
    for column in df.columns:
        field = mapping.get(column.lstrip("﻿").strip())
        if field and field != headers.SKIP:
            chosen.setdefault(field, column)
    missing = sorted(set(required) - set(chosen))
    if missing:
        raise ValueError(f"source lacks the columns for {', '.join(missing)}")
    kept = [c for c in SOURCE_COLUMNS if c in df.columns]
    return df.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f) for f, c in chosen.items()],
        *kept,
    )


def read_registry(
    spark: SparkSession, path: str, mapping: Mapping[str, str] = headers.REGISTRY,
    required: Iterable[str] = ("name", "credit"), format: str = "csv",
) -> DataFrame:
    """Headed registry files (any of the header tables) as fields."""
    reader = spark.read.format(format)
    if format == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"', encoding="UTF-8")
    return map_headers(spread(with_source(reader.load(path))), mapping, required)


def read_positional(spark: SparkSession, path: str, fields=headers.MONTHLY) -> DataFrame:
    """Headerless files whose columns are known by position."""
    schema = ", ".join(f"{f} string" for f in fields)
    reader = spark.read.schema(schema).options(header=False, multiLine=True, escape='"')
    return spread(with_source(reader.csv(path)))


def read_certificate_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_registry(spark, path, headers.CERTIFICATE_CSV)


def read_certificate_table(spark: SparkSession, path: str, years=(), format: str = "csv") -> DataFrame:
    """Certificate lists, optionally of the files that name one of the years."""
    rows = read_registry(spark, path, headers.CERTIFICATE_TABLE, format=format)
    if not years:
        return rows
    return rows.filter(F.col("src_file").rlike("|".join(str(y) for y in years)))


def split_rejects(rows: DataFrame, reason: str = "credit_not_18") -> tuple[DataFrame, DataFrame]:
    """(usable rows, rows whose code is not 18 characters with the reason)."""
    named = rows.filter(~is_empty(F.col("name"))).withColumn("credit", normal_code(F.col("credit")))
    valid = is_credit_code(F.col("credit"))
    province = clean(F.col("province")) if "province" in rows.columns else F.lit(None).cast("string")
    rejects = named.filter(~valid).select(
        F.col("name"), F.col("credit").alias("tax_id"), province.alias("province"),
        F.lit(reason).alias("reason"), *[c for c in ("src_file",) if c in rows.columns],
    )
    return named.filter(valid), rejects


def write_rejects(rejects: DataFrame, path: str) -> None:
    rejects.write.mode("append").csv(path, header=True)


# --- files whose sections have different headers ---------------------------------


def section_kind(section: Column, header: Column) -> Column:
    """base, base_no_header, chain, honor or skip, by section name and headers."""
    names = F.transform(F.coalesce(header, F.array().cast("array<string>")), strip)
    name = strip(F.coalesce(section, F.lit("")))

    def has(*wanted: str) -> Column:
        return F.arrays_overlap(names, F.array(*[F.lit(w) for w in wanted]))

    mentions_company = F.exists(names, lambda h: h.contains("公司"))
    second = clean(F.try_element_at(names, F.lit(2)))
    first = clean(F.try_element_at(names, F.lit(1)))
    return (
        F.when(F.lower(name) == "sheet3", "skip")
        .when(has("登记状态") & has("法定代表人", "注册资本"), "base")
        .when(first.isNotNull() & second.isin(*SECTION_STATUS_WORDS), "base_no_header")
        .when(has("一级分类") & mentions_company, "chain")
        .when(name.isin(*HONOR_SECTIONS), "honor")
        .when(has(*HONOR_HEADERS) & (has("ID") | mentions_company), "honor")
        .when(name.isin(*OTHER_HONOR_SECTIONS), "honor")
        .otherwise("skip")
    )


def route_sections(sections: DataFrame) -> dict[str, DataFrame]:
    """Branches by kind of a table (section, header, cells, …) of raw rows."""
    kinds = sections.withColumn("kind", section_kind(F.col("section"), F.col("header")))
    return {
        k: kinds.filter(F.col("kind") == k).drop("kind")
        for k in ("base", "base_no_header", "chain", "honor")
    }


def pick_cell(header: Column, cells: Column, *names: str) -> Column:
    """First filled cell under any of the headers, names in order of preference.

    Repeated headers are folded: the first filled cell of a header counts.
    """
    pairs = F.arrays_zip(F.transform(header, strip).alias("h"), cells.alias("v"))

    def under(name: str) -> Column:
        hits = F.filter(pairs, lambda p: (p["h"] == name) & ~is_empty(p["v"]))
        return F.try_element_at(hits, F.lit(1))["v"]

    return clean(F.coalesce(*[under(n) for n in names]))


def block_rows(sections: DataFrame, *carried: str) -> DataFrame:
    """Rows with their number and cells: of a table in blocks one per row of a block, of any other as they are.

    A block without rows, which tells a problem, gives one row.
    """
    if "rows" not in sections.columns:
        return sections
    kept = [c for c in (*SOURCE_COLUMNS, "section", "first_row", "header", "problem", *carried) if c in sections.columns]
    out = sections.select(*kept, F.posexplode_outer("rows").alias("__at", "cells"))
    return out.withColumn("row_no", F.col("first_row") + F.coalesce("__at", F.lit(0))).drop("first_row", "__at")


def stripped_header() -> Column:
    return F.transform(F.coalesce("header", F.array().cast("array<string>")), strip)


def section_fields(sections: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rows of sections as fields, by the header that each row or block carries.

    Of several columns of a field the first one counts; headers mapped to
    ``headers.SKIP`` or not at all are left out.
    """
    heads: dict[str, list[str]] = {}
    for header, field in mapping.items():
        if field != headers.SKIP:
            heads.setdefault(field, []).append(header)
    named = sections.withColumn("__names", stripped_header())

    def place(names: list[str]) -> Column:
        found = [F.nullif(F.array_position("__names", n), F.lit(0)) for n in names]
        return found[0] if len(found) == 1 else F.least(*found)

    at = {f: f"__place_{i}" for i, f in enumerate(heads)}
    rows = block_rows(named.withColumns({at[f]: (place(n) - 1).cast("int") for f, n in heads.items()}), *at.values())
    kept = [c for c in (*SOURCE_COLUMNS, "section", "row_no") if c in rows.columns and c not in heads]
    return rows.select(*[F.coalesce(F.get("cells", F.col(at[f])), F.lit("")).alias(f) for f in heads], *kept)


#: Branches of ``staged_sections``; "reject" rows have a reason.
KINDS = ("base", "base_no_header", "chain", "honor", "reject")


def staged_sections(sections: DataFrame, path: str) -> dict[str, DataFrame]:
    """Branches by kind of workbook rows, and the rejects, after one pass over the source.

    The rows, one by one or in blocks, are written once, in one folder per kind; a branch reads its own folder.
    Rejected are sheets that can't be read and chain rows whose code isn't 18 characters
    (the code is looked up in the columns that chain sections keep it in). Header rows
    are left out, but for sections without header, whose first row is data.
    """
    codes = F.array(*[F.lit(h) for h, field in headers.CHAIN.items() if field == "credit"])
    # What depends on the header is found once per block: the kind, and the places of the code, headers in order of preference.
    names = sections.withColumn("__names", stripped_header())
    found = F.transform("__names", lambda n, i: F.struct(F.array_position(codes, n).alias("rank"), i.alias("at")))
    places = F.transform(F.array_sort(F.filter(found, lambda x: x["rank"] > 0)), lambda x: x["at"])
    kinds = names.withColumns({"kind": section_kind(F.col("section"), F.col("header")), "__places": places}).drop("__names")
    rows = block_rows(kinds, "kind", "__places")
    given = F.filter(F.transform("__places", lambda i: F.get("cells", i)), lambda c: ~is_empty(c))
    code = normal_code(clean(F.get(given, F.lit(0))))
    reason = F.when(F.col("problem").isNotNull(), F.col("problem")).when((F.col("kind") == "chain") & ~F.coalesce(is_credit_code(code), F.lit(False)), "credit_not_18")
    rows = rows.withColumn("reason", reason).filter((F.col("row_no") > 0) | (F.col("kind") == "base_no_header") | F.col("problem").isNotNull())
    routed = rows.withColumn("kind", F.when(F.col("reason").isNotNull(), "reject").otherwise(F.col("kind"))).drop("problem", "__places")
    routed = routed.select(*[c for c in routed.columns if c not in ("row_no", "header", "cells", "kind", "reason")], "row_no", "header", "cells", "kind", "reason")
    routed.filter(F.col("kind") != "skip").write.mode("errorifexists").partitionBy("kind").parquet(path)
    stored = sections.sparkSession.read.schema(routed.schema).parquet(path)
    return {k: stored.filter(F.col("kind") == k).drop("kind", *(() if k == "reject" else ("reason",))) for k in KINDS}


# --- tables of existing tags -------------------------------------------------------

#: Columns of a tag table that hold lists, and those that go by two names.
TAG_LISTS = ("chain_industries", "chain_nodes", "honors")
TAG_TEXTS = {
    "chain_positions": ("chain_positions", "chain_position"), "relatedness": ("relatedness",), "financing_raw": ("financing", "financing_raw"),
    "tag_finance": ("tag_finance",), "tag_fit": ("tag_fit",),
}
TAG_SCORES = ("lead_score", "score_reach", "score_attract", "score_fit", "score_pay")


def read_tag_table(rows: DataFrame) -> DataFrame:
    """Existing tags as a tag table, whatever form their lists have.

    A list column may be an array, the text of a JSON list or value, packed text
    ``A | B``, or one value. Text that begins like a list and isn't one is kept as a
    value, and also goes into ``rescued`` (column name to text). Missing columns are
    null; rows without code are left out.
    """
    present = set(rows.columns)
    rescued, lists = [], {}
    for name in TAG_LISTS:
        if name not in present:
            lists[name] = F.lit(None).cast("array<string>")
            continue
        if rows.schema[name].dataType.typeName() == "array":
            lists[name] = unpack(F.col(name).cast("array<string>"))
            continue
        raw = strip(F.coalesce(F.col(name).cast("string"), F.lit("")))
        parsed = F.try_parse_json(raw)
        is_list = F.schema_of_variant(parsed).startswith("ARRAY")
        items = F.when(is_list, F.try_variant_get(parsed, "$", "array<string>")).otherwise(F.array(raw))
        lists[name] = unpack(items)
        rescued.append(F.when(raw.startswith("[") & ~F.coalesce(is_list, F.lit(False)), F.struct(F.lit(name).alias("key"), raw.alias("value"))))
    lists = {name: F.when(F.size(value) > 0, value) for name, value in lists.items()}

    def first(names: Iterable[str]) -> Column:
        found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in present]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    scores = {n: F.col(n).try_cast("smallint") if n in present else F.lit(None).cast("smallint") for n in TAG_SCORES}
    bad = F.map_from_entries(F.filter(F.array(*rescued), lambda x: x.isNotNull())) if rescued else F.lit(None).cast("map<string,string>")
    code = strip(F.coalesce(F.col("credit_code"), F.lit("")))
    return rows.filter(code != "").select(
        code.alias("credit_code"), first(["company_name"]).alias("company_name"),
        *[v.alias(n) for n, v in lists.items()], *[first(names).alias(n) for n, names in TAG_TEXTS.items()],
        *[v.alias(n) for n, v in scores.items()], F.when(F.cardinality(bad) > 0, bad).alias("rescued"),
    )


# --- administrative divisions ------------------------------------------------------

NODE = "level string, name string, adcode string, center string"


def division_schema(depth: int = 4) -> str:
    """Schema of the nested division tree: nodes with their ``districts``."""
    ddl = f"struct<{NODE.replace(' string', ':string')}>"
    for _ in range(depth - 1):
        ddl = f"struct<{NODE.replace(' string', ':string')},districts:array<{ddl}>>"
    return ddl


def _division_files(spark: SparkSession, path: str) -> DataFrame:
    """(src_file, nodes, bad_lines) of division files.

    A file holds one tree per line, or one JSON value over any number of lines:
    a tree, a list of trees, or an object of trees by name.
    """
    tree, ok = division_schema(), lambda n: n["level"].isNotNull()
    files = with_source(spark.read.text(path, wholetext=True))
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), strip), lambda x: x != "")
    parsed = F.transform(lines, lambda x: F.from_json(x, tree))
    body = strip(F.col("value"))
    one = F.array(F.from_json(body, tree))
    listed = F.from_json(F.when(body.startswith("["), body), f"array<{tree}>")
    named = F.map_values(F.from_json(F.when(body.startswith("{"), body), f"map<string,{tree}>"))
    found = files.select(
        "src_file", parsed.alias("by_line"),
        *[F.filter(F.coalesce(x, F.array().cast(f"array<{tree}>")), ok).alias(name) for x, name in ((one, "one"), (listed, "listed"), (named, "named"))],
    ).withColumn("good_lines", F.filter("by_line", ok))
    # A tree over several lines begins with a line that is none.
    by_line = F.coalesce(ok(F.get("by_line", 0)), F.lit(False)) & (F.size("listed") == 0)
    whole = F.when(F.size("listed") > 0, F.col("listed")).when(F.size("named") > 0, F.col("named")).when(F.size("one") > 0, F.col("one"))
    nodes = F.when(by_line | whole.isNull(), F.col("good_lines")).otherwise(whole)
    bad = F.when(by_line | whole.isNull(), F.size("by_line") - F.size("good_lines")).otherwise(0)
    return found.select("src_file", nodes.alias("nodes"), bad.alias("bad_lines"))


def read_division_tree(spark: SparkSession, path: str) -> DataFrame:
    """Division files as flat rows; what can't be read is in ``division_rejects``."""
    return flatten_divisions(_division_files(spark, path).select(F.explode("nodes").alias("node")))


def division_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(src_file, bad_lines) of division files with lines that are no tree."""
    return _division_files(spark, path).filter("bad_lines > 0").select("src_file", "bad_lines")


def flatten_divisions(trees: DataFrame, source: str = "tree") -> DataFrame:
    """Rows of all four levels of a column ``node``, with inherited names."""
    levels = ("province", "city", "district", "street")
    empty = F.lit("")
    current = trees.select("node", empty.alias("parent_adcode"), *[empty.alias(level) for level in levels])
    out = None
    for depth in range(4):
        node = F.col("node")
        level, name = strip(node["level"]), strip(node["name"])
        adcode = F.coalesce(strip(node["adcode"]), empty)
        named = [
            F.when(level == upper, name).otherwise(F.col(upper)).alias(upper) for upper in levels
        ]
        known = F.coalesce((level != "") & (name != ""), F.lit(False))
        centre = F.split(node["center"], ",", 2)
        base = current.filter(known)
        rows = base.select(
            F.concat_ws("|", level, adcode, F.col("parent_adcode"), name).alias("row_key"),
            adcode.alias("adcode"), level.alias("level"), name.alias("name"), "parent_adcode", *named,
            F.try_element_at(centre, F.lit(1)).try_cast("double").alias("center_lng"),
            F.try_element_at(centre, F.lit(2)).try_cast("double").alias("center_lat"),
            F.lit(source).alias("source"),
        )
        out = rows if out is None else out.unionByName(rows)
        if depth < 3:
            current = base.select(
                F.explode(node["districts"]).alias("node"), adcode.alias("parent_adcode"), *named
            )
    return out
