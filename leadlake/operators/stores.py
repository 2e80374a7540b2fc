"""Tables on storage: two stores joined without a shuffle, and writes of the touched parts only.

Bucketed stores. A table kept in a database is bucketed and sorted by its key. Tables
of different databases with equal buckets join bucket by bucket, without an exchange.

Keyed tables. Rows lie in ``parts`` folders by a hash of their key. An upsert or patch
reads and rewrites the folders that its keys fall into, and no others, by dynamic
partition overwrite; the folder numbers, at most ``parts``, are all that the driver sees.

Sliced tables. Rows lie in one folder per value of a column. A refresh replaces one folder
without reading it, also by nothing.

A write that is lost midway leaves old or new folders, never half of one, and can be
repeated: merges of the same changes give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.operators.upsert import SEQ, patch_columns, upsert_rows

PART = "part"


# --- bucketed stores --------------------------------------------------------------


def create_store(spark: SparkSession, name: str, location: str) -> None:
    """A database whose tables lie below ``location``."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION '{location}'")


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """Write a table bucketed and sorted by its key, one file a bucket, and read it from its database."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def coverage(certified: DataFrame, registry: DataFrame, key: str = "credit_code") -> DataFrame:
    """Different keys of one store, and how many of them the other one has.

    The right side is reduced to one row per key, so that it may repeat keys. Of
    tables bucketed alike, only one partial count per task is exchanged.
    """
    wanted = certified.filter(F.col(key).isNotNull()).groupBy(key).agg(F.lit(1).alias("__one")).drop("__one")
    known = registry.groupBy(key).agg(F.lit(1).alias("__known"))
    return wanted.join(known, key, "left").agg(F.count(F.lit(1)).alias("certified"), F.count("__known").alias("in_registry"))


# --- parts that are touched ---------------------------------------------------------


def part_of(keys: Sequence[str], parts: int) -> Column:
    """Folder number of a key: from the first digits of its MD5."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") % parts).cast("int")


@dataclass(frozen=True)
class KeyedTable:
    """Rows unique on ``keys``, in folders by a hash of them."""

    path: str
    keys: tuple[str, ...]
    parts: int

    def _write(self, rows: DataFrame) -> None:
        placed = rows.withColumn(PART, part_of(self.keys, self.parts))
        dealt = placed.repartition(PART).sortWithinPartitions(PART, *self.keys)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self._write(rows)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop(PART)

    def touched(self, changes: DataFrame) -> list[int]:
        """Folders that the keys of the changes fall into: at most ``parts`` numbers."""
        return sorted(r[0] for r in changes.select(part_of(self.keys, self.parts)).distinct().collect())

    def _merge(self, changes: DataFrame, merged: Callable[[DataFrame], DataFrame]) -> list[int]:
        parts = self.touched(changes)
        if parts:
            current = changes.sparkSession.read.parquet(self.path)
            self._write(merged(current.filter(F.col(PART).isin(parts)).drop(PART)))
        return parts

    def upsert(self, changes: DataFrame, seq: str = SEQ, arrival: Sequence[str] = ()) -> list[int]:
        """Whole rows replace older ones; returns the folders that were rewritten."""
        return self._merge(changes, lambda current: upsert_rows(current, changes, self.keys, seq, arrival))

    def patch(self, patch: DataFrame, columns: Sequence[str], seq: str | None = SEQ) -> list[int]:
        """Only the listed columns change; returns the folders that were rewritten."""
        return self._merge(patch, lambda current: patch_columns(current, patch, columns, self.keys, seq))


#: Characters that stand as % and two digits in names of partition folders.
_ESCAPED = re.compile(r"[\x00-\x1f\"#%'*/:=?\\\x7f{}\[\]^]")


@dataclass(frozen=True)
class SlicedTable:
    """Rows in one folder per value of a text column."""

    path: str
    column: str

    def create(self, rows: DataFrame) -> None:
        rows.repartition(self.column).write.mode("overwrite").partitionBy(self.column).parquet(self.path)

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """All slices; the schema keeps the column a text."""
        names = schema.names
        return spark.read.schema(schema).parquet(self.path).select(*names)

    def refresh(self, fresh: DataFrame, value: str | None) -> None:
        """The rows of one value go and ``fresh`` comes: one folder is written, and none read."""
        name = "__HIVE_DEFAULT_PARTITION__" if value in (None, "") else _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value)
        fresh.drop(self.column).write.mode("overwrite").parquet(f"{self.path}/{self.column}={name}")


def files_by_part(spark: SparkSession, path: str, column: str = PART) -> DataFrame:
    """(folder value, file) of a partitioned table: what a write replaced shows in two of them."""
    return spark.read.parquet(path).select(F.col(column).cast("string").alias(column), F.col("_metadata.file_path").alias("file")).distinct()


def rewritten(before: DataFrame, after: DataFrame, column: str = PART) -> DataFrame:
    """Folders whose files differ, from two stored results of ``files_by_part``."""
    gone, new = before.join(after, [column, "file"], "left_anti"), after.join(before, [column, "file"], "left_anti")
    return gone.select(column).union(new.select(column)).distinct()
