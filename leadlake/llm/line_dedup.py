"""Remove repeated passages by overlapping windows of three lines.

Every three consecutive lines of a document are hashed. Of a window that occurs
more than once in all documents, the first occurrence, by document and position,
stays; the lines of all later ones are covered. Overlapping covered windows merge,
and the lines that no window covers are put together again.

Defined results: a null or empty text is one empty line and stays as it is; a
document of fewer than three lines has no window and stays, unless ``short`` takes
it, if not empty, as one window of all its lines; documents are ordered
by id, rows without id first, then by the hash of the text; rows that repeat id
and text are one document, so that none loses lines to the other; blank lines
count as any other line; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.llm.common import column, folder, stored
from leadlake.llm.minhash import row_key

SPAN = 3


def _hashes(lines: Column, at: Column, span: int) -> list[Column]:
    """128 bits of the lines from ``at`` on; null lines beyond the end change no hash."""
    own = [F.get(lines, at + i) for i in range(span)]
    return [F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit("window"), *own).alias("h2")]


def dedup_lines(
    docs: DataFrame, *, span: int = SPAN, short: bool = False, work: str | None = None, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, text.

    Windows are counted by a grouping that combines in the map tasks; only windows
    that repeat are joined back, so a passage of a third of all documents is one
    row on one side of a join whose large partitions Spark splits.
    """
    path = folder(docs.sparkSession, work)
    doc_id, text = column(docs, id_column, "long"), column(docs, text_column, "string")
    read = docs.select(
        doc_id.alias("doc_id"), *row_key(doc_id, text), text.alias("text"), F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("lines"),
    )
    n = F.size("lines")
    windows = (
        read.filter((n >= span) | (F.lit(short) & (F.length("text") > 0)))
        .select("doc_id", "k1", "k2", "lines", F.explode(F.sequence(F.lit(0), F.greatest(n - span, F.lit(0)))).alias("at"))
        .select("doc_id", "k1", "k2", "at", *_hashes(F.col("lines"), F.col("at"), span))
    )
    place = F.struct("doc_id", "k1", "k2", "at")
    repeated = stored(
        windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("h1", "h2", "first"),
        f"{path}/repeated",
    )
    later = windows.join(repeated, ["h1", "h2"]).filter(place > F.col("first")).select("k1", "k2", "at").distinct()
    # What stays lies between covered windows: up to each window that begins behind the end of the one before, and behind the last.
    before = F.lag("at", 1, -span).over(Window.partitionBy("k1", "k2").orderBy("at"))
    gaps = (
        later.withColumn("begin", before + span)
        .groupBy("k1", "k2").agg(
            F.sort_array(F.collect_list(F.when(F.col("at") > F.col("begin"), F.struct("begin", (F.col("at") - F.col("begin")).alias("length"))))).alias("gaps"),
            (F.max("at") + span).alias("tail"),
        )
    )
    lines = F.col("lines")
    kept = F.concat(
        F.flatten(F.transform("gaps", lambda g: F.slice(lines, g["begin"] + 1, g["length"]))),
        F.slice(lines, F.col("tail") + 1, F.greatest(n - F.col("tail"), F.lit(0))),
    )
    return (
        read.join(gaps, ["k1", "k2"], "left")
        .select("doc_id", "text", n.cast("long").alias("n_lines"), F.when(F.col("tail").isNotNull(), kept).alias("kept"))
        .select(
            "doc_id", "n_lines", F.when(F.col("kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"),
            F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
        )
    )
