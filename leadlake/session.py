"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder of a local session without a shared one.
_LOCAL: list[str] = []


def get_session(app_name: str = "leadlake", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution; sizes are left to the cluster.

    Joins carry no broadcast hints: Spark broadcasts a side only when its
    planned or measured size is below the threshold, and otherwise shuffles
    with skew handling.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.compression.codec": "zstd",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    tune(spark)
    return spark


def tune(spark: SparkSession) -> None:
    """Compile wide cleaning projections into methods the JVM can optimise.

    HotSpot leaves methods above 8000 bytes interpreted. With this limit Spark
    evaluates such stages through split projections instead of one method.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def work_dir(spark: SparkSession) -> str:
    """A new folder under the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of the machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = _LOCAL[0] if _LOCAL else _LOCAL.append(tempfile.mkdtemp(prefix="leadlake-")) or _LOCAL[0]
    return f"{shared.rstrip('/')}/leadlake-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write a frame and read it back: later steps start from files of known size, not from a recomputation."""
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
