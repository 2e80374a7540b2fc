"""Mix sources to target weights by repeating documents.

Tokens are counted per source, each source gets a target, and target over size
is its repetition rate. A document is emitted floor(rate) times plus once more
if its hash-seeded Bernoulli draw, with the fraction as probability, succeeds.

Defined results: a null text has size 0; null is a source of its own and comes
last; a source without tokens has target 0 and is not emitted; rows that repeat
a doc_id share its draw; a row without doc_id draws by its text; an empty table
gives no rows. Input columns never clash with those added here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.llm.common import WORD, column, folder, packed, small, stored

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Source tables of up to so many rows are broadcast.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    The sources share ``share`` times all tokens by weight; none gets more than
    ``most`` times its size, and what is cut goes to the others by weight. That
    is water filling: in the order of limit over weight, a source is cut as long
    as the level over the rest lies above its limit; the rest share one level.
    The windows see one row per source, after the aggregation.
    """
    everything = Window.partitionBy()
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, rest = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", number)
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") - 1) % len(weights) + 1))
        .withColumn("limit", F.col("source_size") * most)
        .withColumn("open", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("level", F.col("open") / F.sum("weight").over(rest))
        .withColumn("cut", F.col("level") * F.col("weight") > F.col("limit"))
        .withColumn("shared", F.max(F.when(~F.col("cut"), F.col("level"))).over(everything))
        .select(
            "source", "source_size",
            F.when(F.col("cut"), F.col("limit")).otherwise(F.least(F.col("shared") * F.col("weight"), F.col("limit"))).alias("target"),
        )
    )


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number from 0 up to 1 that depends on the seed and the doc_id only."""
    key = F.coalesce(doc_id.cast("string"), F.md5(text), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan_mixture(
    docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 1, work: str | None = None,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """Every row of ``docs`` as ``_doc``, with size, source_size, target and copies."""
    doc_id, text, source = (F.col(f"_doc.`{c}`") for c in (id_column, text_column, source_column))
    sizes = docs.select(column(docs, source_column, "string").alias("source"), words(column(docs, text_column, "string")).alias("size"))
    path = folder(docs.sparkSession, work)
    targets = small(stored(source_targets(sizes, weights, share, most), f"{path}/targets"), BROADCAST_SOURCES)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sized = packed(docs).withColumn("size", words(text))
    return (
        sized.join(targets, source.cast("string").eqNullSafe(targets["source"]))
        .withColumn("rate", rate)
        .withColumn("copies", (F.floor("rate") + (draw(doc_id, text, seed) < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
        .select("_doc", "size", "source_size", "target", "copies")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: the columns of ``docs``, each row as often as the mix takes it."""
    planned = plan_mixture(docs, **options).filter("copies > 0")
    return planned.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")
