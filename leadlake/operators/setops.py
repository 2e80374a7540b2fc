"""Key sets across sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_keys(key: str, *sources: DataFrame) -> DataFrame:
    """Distinct keys of all sources; each is reduced before the union."""
    keys = [s.select(key).filter(F.col(key).isNotNull()).distinct() for s in sources]
    return reduce(DataFrame.union, keys).distinct()


def distinct_report(df: DataFrame, key: str) -> DataFrame:
    """(entries, distinct_keys, duplicates) of a key column."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"),
        F.count(F.lit(1)).alias("distinct_keys"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicates"),
    )


def overlap_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(right_total, matched, coverage_pct): how much of the right side is known left."""
    known = left.select(key).distinct().withColumn("__known", F.lit(1))
    wanted = right.select(key).filter(F.col(key).isNotNull()).distinct()
    total, matched = F.count(F.lit(1)), F.count("__known")
    return wanted.join(known, key, "left").agg(
        total.alias("right_total"), matched.alias("matched"),
        F.round(matched * 100 / F.greatest(total, F.lit(1)), 2).alias("coverage_pct"),
    )


def missing_keys(wanted: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Keys that should be there but are not."""
    return wanted.select(key).distinct().join(loaded.select(key).distinct(), key, "left_anti")
