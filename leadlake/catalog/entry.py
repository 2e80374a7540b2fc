"""Registry of named queries, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.catalog.domain_sql import with_tables
from leadlake.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register a query; ``needs`` names the derived tables its SQL reads."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # The caller's session need not come from get_session.
            tune(spark)
            return plain(function(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(*needs, body=sql)
        return function

    return register


def query_like(name: str, other: str):
    """Register a query whose result is that of ``other``, reached another way."""

    def register(function: Query) -> Query:
        query(name)(function)
        ORACLES[name] = ORACLES[other]
        return function

    return register


def plain(df: DataFrame) -> DataFrame:
    """Columns in the types both engines share: text, long and double."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int"):
            c = c.cast("long")
        elif kind.startswith("decimal") or kind == "float":
            c = c.cast("double")
        elif kind in ("date", "boolean") or kind.startswith("timestamp"):
            c = c.cast("string")
        elif kind == "array<string>":
            c = F.array_join(c, "|")
        out.append(c.alias(name))
    return df.select(*out)
