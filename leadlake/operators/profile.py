"""Data-quality profile of raw registry tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from leadlake.fixed_values import CAPITAL_EDGES, INSURED_EDGES, LENGTH_EDGES
from leadlake.functions.capital import capital_currency, stated_wan
from leadlake.functions.contacts import is_mobile
from leadlake.functions.identity import is_credit_code, normal_code
from leadlake.functions.text import bucket_label, clean, is_empty, split_multi
from leadlake.operators.aggregates import count_if
from leadlake.operators.ranking import top_per_key


@dataclass(frozen=True)
class Dataset:
    """Which raw column plays which part in the profile."""

    credit: str
    status: str | None = None
    province: str | None = None
    city: str | None = None
    company_type: str | None = None
    industry: str | None = None
    scale: str | None = None
    established: str | None = None
    capital: str | None = None
    insured: str | None = None
    scope: str | None = None
    address: str | None = None
    mobile: tuple[str, ...] = ()
    landline: tuple[str, ...] = ()
    email: tuple[str, ...] = field(default=())


def column_profile(df: DataFrame, columns) -> DataFrame:
    """(column, rows, filled, filled_pct, bytes, avg_bytes), in one pass."""
    columns = list(columns)
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        text = F.col(c).cast("string")
        measures.append(count_if(~is_empty(text)).alias(f"f{i}"))
        measures.append(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias(f"b{i}"))
    wide = df.agg(*measures)
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("filled"), F.col(f"b{i}").alias("bytes"))
                for i, c in enumerate(columns)
            ]
        )
    )
    return wide.select("rows", cells.alias("cell")).select(
        "cell.column", "rows", "cell.filled", "cell.bytes",
        F.round(F.col("cell.filled") * 100 / F.greatest("rows", F.lit(1)), 2).alias("filled_pct"),
        F.round(F.col("cell.bytes") / F.greatest("rows", F.lit(1)), 1).alias("avg_bytes"),
    )


def credit_validity(df: DataFrame, column: str) -> DataFrame:
    code = normal_code(F.col(column))
    kind = (
        F.when(is_empty(code), "empty").when(is_credit_code(code), "valid").otherwise("malformed")
    )
    return df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def value_tops(df: DataFrame, dimensions: dict[str, Column], n: int) -> DataFrame:
    """(dim, k, n): the n most frequent values of every dimension, in one pass."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(d).alias("dim"), clean(c).alias("k")) for d, c in dimensions.items()])
    )
    rows = df.select(pairs.alias("pair")).select("pair.*").filter(F.col("k").isNotNull())
    counts = rows.groupBy("dim", "k").agg(F.count(F.lit(1)).alias("n"))
    return top_per_key(counts, ["dim"], [F.desc("n"), F.asc("k")], n)


def dataset_dimensions(ds: Dataset) -> dict[str, Column]:
    """The value distributions of a data set that are reported."""
    names = {
        "status": ds.status, "province": ds.province, "type": ds.company_type,
        "industry": ds.industry, "scale": ds.scale,
    }
    dims = {d: F.col(c) for d, c in names.items() if c}
    if ds.province and ds.city:
        dims["city"] = F.when(
            ~is_empty(F.col(ds.city)), F.concat_ws("|", F.coalesce(ds.province, F.lit("")), ds.city)
        )
    if ds.established:
        year = F.substring(ds.established, 1, 4)
        dims["year"] = F.when(year.rlike("^[0-9]{4}$"), year)
    if ds.capital:
        dims["currency"] = F.coalesce(capital_currency(F.col(ds.capital)), F.lit("未填"))
    return dims


def histograms(df: DataFrame, ds: Dataset) -> DataFrame:
    """(measure, bucket, n): text lengths, capital and staff, in one pass."""
    measures = {}
    for name, column in (("scope_len", ds.scope), ("addr_len", ds.address)):
        if column:
            size = F.when(is_empty(F.col(column)), 0).otherwise(F.length(column))
            measures[name] = bucket_label(size, LENGTH_EDGES)
    if ds.capital:
        wan = stated_wan(F.col(ds.capital))
        measures["capital_wan"] = F.when(wan.isNull(), "未知").otherwise(
            bucket_label(F.floor(wan), CAPITAL_EDGES)
        )
    if ds.insured:
        staff = F.when(F.col(ds.insured).rlike("^[0-9]+$"), F.col(ds.insured).try_cast("long"))
        measures["insured"] = F.when(staff.isNull(), "未知").otherwise(bucket_label(staff, INSURED_EDGES))
    pairs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("measure"), b.alias("bucket")) for m, b in measures.items()])
    )
    rows = df.select(pairs.alias("pair")).select("pair.*")
    return rows.groupBy("measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _reach_columns(ds: Dataset) -> dict[str, Column]:
    def parts(columns) -> Column:
        return F.concat(F.array().cast("array<string>"), *[split_multi(F.col(c)) for c in columns])

    numbers = F.filter(parts(ds.mobile), is_mobile)
    return {
        "__mobiles": F.size(numbers),
        "__landline": F.size(parts(ds.landline)) > 0,
        "__email": F.size(parts(ds.email)) > 0,
    }


def reach_matrix(df: DataFrame, ds: Dataset, by=()) -> DataFrame:
    """How many rows can be reached, by channel and by combination."""
    flagged = df.withColumns(_reach_columns(ds))
    mobile, landline, mail = F.col("__mobiles") > 0, F.col("__landline"), F.col("__email")
    return flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(mobile).alias("mobile"),
        count_if(landline).alias("landline"),
        count_if(mail).alias("email"),
        count_if(mobile | landline).alias("phone"),
        count_if(mobile & mail).alias("mobile_and_email"),
        count_if(mobile | landline | mail).alias("reachable"),
        count_if(~(mobile | landline | mail)).alias("unreachable"),
    )


def mobiles_per_row(df: DataFrame, ds: Dataset) -> DataFrame:
    """(mobiles, n): rows by number of mobiles; 5 stands for five or more."""
    capped = F.least(F.col("__mobiles"), F.lit(5)).alias("mobiles")
    return df.withColumns(_reach_columns(ds)).groupBy(capped).agg(F.count(F.lit(1)).alias("n"))


def group_report(df: DataFrame, ds: Dataset, group: str) -> DataFrame:
    """Reach per source group with the reachable share."""
    share = F.round(F.col("reachable") * 100 / F.greatest("rows", F.lit(1)), 2)
    return reach_matrix(df, ds, [group]).withColumn("reach_pct", share)


def load_report(rows: DataFrame, file: str, code: str) -> DataFrame:
    """Per source file: rows, unusable rows, companies, surrogate keys, duplicates.

    ``rows`` are mapped rows with a key column that is NULL for unusable ones.
    Rows are counted per (file, key) first, so a large file is not one task.
    """
    per_key = rows.groupBy(file, code).agg(F.count(F.lit(1)).alias("n"))
    usable = F.col(code).isNotNull()
    return per_key.groupBy(file).agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(~usable, F.col("n"))), F.lit(0)).alias("bad_rows"),
        count_if(usable).alias("companies"),
        count_if(F.col(code).startswith("N")).alias("surrogate"),
        F.coalesce(F.sum(F.when(usable, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
    )


def header_census(files: DataFrame) -> DataFrame:
    """(signature, files, columns) of files given as (file, headers array)."""
    signature = F.array_join("headers", "|")
    return files.groupBy(signature.alias("signature")).agg(
        F.count(F.lit(1)).alias("files"), F.max(F.size("headers")).alias("columns")
    )


def fill_rates(df: DataFrame, columns, by) -> DataFrame:
    """Percentage of filled cells per column and group."""
    rates = [
        F.round(count_if(~is_empty(F.col(c).cast("string"))) * 100 / F.count(F.lit(1)), 1).alias(c)
        for c in columns
    ]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *rates)


def load_observed(rows: DataFrame, kept: Callable[[DataFrame], DataFrame], path: str, code: str = "credit_code") -> dict[str, int]:
    """Write what ``kept`` makes of keyed rows, and return the figures of the load.

    rows, bad_rows (without key), companies, surrogate keys, duplicates: observed while
    the rows pass on their way to ``path``, so nothing is read or counted a second time.
    """
    given, taken = Observation("given"), Observation("taken")
    seen = rows.observe(given, F.count(F.lit(1)).alias("rows"), count_if(F.col(code).isNull()).alias("bad_rows"))
    made = kept(seen.filter(F.col(code).isNotNull()))
    made = made.observe(taken, F.count(F.lit(1)).alias("companies"), count_if(F.col(code).startswith("N")).alias("surrogate"))
    made.write.mode("errorifexists").parquet(path)
    figures = {**given.get, **taken.get}
    return {**figures, "duplicates": figures["rows"] - figures["bad_rows"] - figures["companies"]}
