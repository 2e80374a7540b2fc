"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are range-partitioned and sorted, the totals of the partitions give each
one its offset in the whole, and the running sum of sizes is cut at equal
targets. A row belongs to the shard that holds the middle of its bytes, so a cut
moves by at most half a row.

Defined results: a null text has no bytes; every row adds ``overhead`` bytes, so
empty texts are dealt out as well; rows without key come first; ties are ordered
by the tie columns, and equal rows are interchangeable; an empty table gives no
rows; a row larger than a target leaves shards empty. Columns of the input named
like those added here are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.llm.common import folder, packed, stored

SHARDS, OVERHEAD = 16, 1


def text_bytes(text: Column, overhead: int = OVERHEAD) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def last_at_most(values: Column, wanted: Column) -> Column:
    """Place of the last of ascending ``values`` that is at most ``wanted``, by halving; the first one is."""
    def half(range_: Column, _: Column) -> Column:
        middle = F.shiftright(range_["low"] + range_["high"] + 1, 1)
        here = F.get(values, middle) <= wanted
        low, high = F.when(here, middle).otherwise(range_["low"]), F.when(here, range_["high"]).otherwise(middle - 1)
        return F.struct(low.alias("low"), high.alias("high"))

    whole = F.struct(F.lit(0).alias("low"), (F.size(values) - 1).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(values)))), whole, half)["low"]


def assign_shards(
    rows: DataFrame, size: Column, order: list[Column], *, shards: int = SHARDS, work: str | None = None,
) -> DataFrame:
    """The columns of ``rows`` with size, shard (from 0) and slot (gapless from 0 in each shard).

    ``size`` and ``order`` refer to the fields of ``_doc``, the packed row. The rows are shuffled once; what
    follows reads three narrow columns of the stored rows. Row numbers inside a
    partition are taken from the sorted partition itself, offsets from one total
    per partition.
    """
    spark, path = rows.sparkSession, folder(rows.sparkSession, work)
    keyed = packed(rows).withColumn("size", size)
    # The last key splits rows that tie in everything else; the sorted result is stored, so it is drawn once.
    keyed = keyed.withColumn("tie", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*order, F.col("tie")]
    number = F.monotonically_increasing_id()
    ranged = stored(
        keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .select("_doc", "size", F.shiftright(number, 33).alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")),
        f"{path}/ranged",
    )
    # One row per partition.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    offsets = stored(
        totals.select(
            "part",
            F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
        ),
        f"{path}/offsets",
    )
    running = F.sum("size").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    middle = F.col("bytes_before") + F.coalesce(F.col("inside"), F.lit(0)) + F.col("size") / 2
    # Where each shard begins in each partition: at most one row per shard and one per partition.
    runs = stored(
        ranged.select("part", "place", "size").withColumn("inside", running).join(offsets, "part")
        .withColumn("shard", F.least(F.floor(middle * shards / F.col("all_bytes")), F.lit(shards - 1)).cast("int"))
        .groupBy("part", "shard").agg(F.min("place").alias("begin"), F.min(F.col("rows_before") + F.col("place")).alias("index")),
        f"{path}/runs",
    )
    firsts = runs.groupBy("shard").agg(F.min("index").alias("first"))
    cuts = (
        runs.join(firsts, "shard").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("begin", "shard", "first"))).alias("cuts"))
        .join(offsets.select("part", "rows_before"), "part")
    )
    cut = F.get("cuts", last_at_most(F.col("cuts.begin"), F.col("place")))
    own = {"size", "shard", "slot"}
    placed = ranged.join(cuts, "part").withColumn("cut", cut)
    return placed.select(
        *[F.col(f"_doc.`{c}`").alias(c) for c in rows.columns if c.lower() not in own],
        F.col("size").cast("long"), F.col("cut.shard").alias("shard"),
        (F.col("rows_before") + F.col("place") - F.col("cut.first")).cast("long").alias("slot"),
    )


def shard_documents(
    docs: DataFrame, *, shards: int = SHARDS, work: str | None = None, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Documents in the order of their id, with size, shard and slot."""
    text = F.col(f"_doc.`{text_column}`").cast("string")
    order = [F.col(f"_doc.`{id_column}`"), F.xxhash64(text)]
    return assign_shards(docs, text_bytes(text), order, shards=shards, work=work)
