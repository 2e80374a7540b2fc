"""Helpers that several training-data operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.session import work_dir

#: ASCII white space, as the byte set that Python's ``bytes.split`` uses.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def folder(spark: SparkSession, work: str | None) -> str:
    """``work``, or a new folder under the shared folder of the session."""
    return work or work_dir(spark)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a frame and read it back: later steps start from files, not from a recomputation."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark a stored frame for broadcast if a count proves that it has at most ``rows`` rows.

    Larger frames are returned as they are and joined by a shuffle; the result is the same.
    """
    return F.broadcast(df) if df.count() <= rows else df


def packed(df: DataFrame, name: str = "_doc") -> DataFrame:
    """One struct column with the whole row, so that no input column can clash with another name."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name))


def column(df: DataFrame, name: str, kind: str) -> Column:
    return df[f"`{name}`"].cast(kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow``, with this package sent to the Python workers once per application.

    The archive is built beside the driver only; Spark itself copies it to the executors.
    """
    context = df.sparkSession.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        package = Path(__file__).resolve().parents[1]
        archive = os.path.join(tempfile.mkdtemp(), "leadlake_package.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(archive)
    return df.mapInArrow(function, schema)
