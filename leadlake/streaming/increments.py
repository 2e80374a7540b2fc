"""Incremental loads with Structured Streaming.

Target layout: ``<target>/delta`` holds one folder per load, ``<target>/ledger`` one
record per load, written when its data is complete. A load goes by a label (for a
micro-batch, its number). It writes only its own rows, so its cost does not depend on
the table. A label that the ledger has is not loaded again, and readers take the
folders that the ledger names, one per label: a folder of a lost or unfinished write
is never read, and nothing is overwritten while it may be read. Readers merge by
key, and ``compact`` folds the loads into a new target.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadlake.operators.aggregates import contact_flags
from leadlake.operators.ranking import keep_last, top_per_key
from leadlake.schemas import CONTACT_KEY
from leadlake.streaming import flags

CODE = "credit_code"
BATCH = "batch_id"


def file_stream(
    spark: SparkSession, path: str, schema, format: str = "parquet", name_filter: str | None = None, **options
) -> DataFrame:
    """Files arriving in a folder; each is read once per checkpoint."""
    reader = spark.readStream.format(format).schema(schema).options(**options)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.load(path)


def run_available(stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process everything that has arrived since the last run, then stop."""
    return (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest(stream: DataFrame, checkpoint: str, target: str) -> StreamingQuery:
    """Append arriving rows; a second run on the checkpoint adds nothing twice."""
    return (
        stream.writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


LEDGER = "label string, load string"


def _ledger(spark: SparkSession, target: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(f"{target}/ledger")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def loaded(spark: SparkSession, target: str, label: str) -> bool:
    """Whether the ledger has the label."""
    return not _ledger(spark, target).filter(F.col("label") == label).isEmpty()


def load_once(rows: DataFrame, target: str, label: str) -> bool:
    """Add rows under a label: data first, then its record. False, and nothing done, if the ledger has the label.

    Of two writers of one label that meet, the one with the lesser folder name counts for all readers.
    """
    spark = rows.sparkSession
    if loaded(spark, target, label):
        return False
    load = uuid.uuid4().hex
    rows.write.parquet(f"{target}/delta/load={load}")
    spark.createDataFrame([(label, load)], LEDGER).coalesce(1).write.mode("append").parquet(f"{target}/ledger")
    return True


def read_loads(spark: SparkSession, target: str) -> DataFrame:
    """Rows of all loads that the ledger has."""
    valid = _ledger(spark, target).groupBy("label").agg(F.min("load").alias("load")).select("load")
    return spark.read.parquet(f"{target}/delta").join(valid, "load", "left_semi").drop("load")


def write_delta(rows: DataFrame, batch: int, target: str) -> None:
    load_once(rows.withColumn(BATCH, F.lit(batch).cast("long")), target, str(batch))


def upsert_stream(
    stream: DataFrame, checkpoint: str, target: str, keys: Sequence[str], seq: str, arrival: Sequence[str]
) -> StreamingQuery:
    """Keep the row with the greatest sequence value per key, batch by batch."""

    def on_batch(rows: DataFrame, batch: int) -> None:
        order = [F.desc_nulls_last(seq), *[F.desc_nulls_last(a) for a in arrival]]
        write_delta(top_per_key(rows, list(keys), order, 1), batch, target)

    return run_available(stream, checkpoint, on_batch)


def read_upserted(spark: SparkSession, target: str, keys: Sequence[str], seq: str, arrival: Sequence[str]) -> DataFrame:
    """Current rows of a target written by ``upsert_stream``."""
    deltas = read_loads(spark, target)
    order = [F.desc_nulls_last(seq), F.desc(BATCH), *[F.desc_nulls_last(a) for a in arrival]]
    return top_per_key(deltas, list(keys), order, 1).drop(BATCH)


def contact_change_stream(stream: DataFrame, checkpoint: str, target: str, arrival: Sequence[str]) -> StreamingQuery:
    """Changes (contact key, ``op`` add or delete): the last one per contact counts."""

    def on_batch(rows: DataFrame, batch: int) -> None:
        write_delta(keep_last(rows, CONTACT_KEY, arrival), batch, target)

    return run_available(stream, checkpoint, on_batch)


def flag_stream(stream: DataFrame, checkpoint: str, target: str, forget_ms: int | None = None) -> StreamingQuery:
    """Flags that change, batch by batch, from keyed state: a batch costs what it brings, not what came before."""
    conf = stream.sparkSession.conf
    before = conf.get(flags.PROVIDER)
    conf.set(flags.PROVIDER, flags.ROCKS)
    try:
        return run_available(flags.changed_flags(stream, forget_ms), checkpoint, lambda rows, batch: write_delta(rows, batch, target))
    finally:
        conf.set(flags.PROVIDER, before)


def read_flags(spark: SparkSession, target: str) -> DataFrame:
    """Current flags of a target written by ``flag_stream``."""
    return keep_last(read_loads(spark, target), [CODE], [BATCH]).drop(BATCH)


def _last_changes(deltas: DataFrame, arrival: Sequence[str]) -> DataFrame:
    return keep_last(deltas, CONTACT_KEY, [BATCH, *arrival]).drop(BATCH)


def current_contacts(spark: SparkSession, target: str, arrival: Sequence[str]) -> DataFrame:
    return _last_changes(read_loads(spark, target), arrival).filter(F.col("op") == "add").drop("op")


def current_flags(spark: SparkSession, target: str, arrival: Sequence[str], after_batch: int | None = None) -> DataFrame:
    """Reach flags of the companies that the stream has touched.

    With ``after_batch`` only companies of later batches are computed, from their
    own contacts; their rows replace those of an earlier result.
    """
    deltas = read_loads(spark, target)
    touched = deltas if after_batch is None else deltas.filter(F.col(BATCH) > after_batch)
    touched = touched.select(CODE).distinct()
    if after_batch is not None:
        deltas = deltas.join(touched, CODE, "left_semi")
    contacts = _last_changes(deltas, arrival).filter(F.col("op") == "add").drop("op")
    return touched.join(contact_flags(contacts), CODE, "left").fillna(0)


def compact_contacts(spark: SparkSession, target: str, into: str, arrival: Sequence[str], partitions: int) -> None:
    """Write the last change of every contact to a new target as its first delta.

    Deletions stay, so that companies without contacts keep their flags.
    """
    last = _last_changes(read_loads(spark, target), arrival)
    write_delta(last.repartition(partitions, *CONTACT_KEY), 0, into)


def compact(
    spark: SparkSession, target: str, into: str, keys: Sequence[str], seq: str, arrival: Sequence[str], partitions: int
) -> None:
    """Write the merged table to a new target as its first delta."""
    merged = read_upserted(spark, target, keys, seq, arrival)
    write_delta(merged.repartition(partitions, *keys), 0, into)


def without_replays(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """Drop repeated changes that arrive within the delay of the first one."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
