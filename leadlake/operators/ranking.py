"""Best row per key, top rows per key, paging and exact percentiles.

Rank filters ``row_number() <= n`` are planned with a group limit before the
shuffle, so a key that holds a third of all rows sends only n rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlake.session import stored, work_dir

RANK = "__rank"

#: Accuracy of the cuts around a percentile: each is off by at most one in this many of a key's rows.
SKETCH = 10_000


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of every key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(RANK, F.row_number().over(window)).filter(F.col(RANK) <= n).drop(RANK)


def keep_best(df: DataFrame, keys: Sequence[str], score: str, arrival: Sequence[str]) -> DataFrame:
    """The row with the highest score per key; the earliest one of equals."""
    return top_per_key(df, keys, [F.desc_nulls_last(score), *[F.asc(a) for a in arrival]], 1)


def keep_last(df: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """The row that arrived last per key."""
    return top_per_key(df, keys, [F.desc_nulls_last(a) for a in arrival], 1)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def after_key(df: DataFrame, key: str, last: str, size: int) -> DataFrame:
    """Next page in key order, resumed after the last key seen."""
    return df.filter(F.col(key) > last).orderBy(key).limit(size)


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float]
) -> DataFrame:
    """Exact order statistics per key: element floor(n * p) of the sorted values.

    One pass sketches two cuts around each wanted position, a second counts the values
    between the cuts. The counts tell which range holds each position, whatever the
    sketch missed, and a third pass ranks the values of these ranges only. Cuts and
    ranges are a row per key and position: they are stored between the passes, so that
    Spark sees how small they are, and no pass moves the values that it only counts.
    """
    keys, work = list(keys), work_dir(df.sparkSession)
    reach = 2 / SKETCH
    cut_at = sorted({min(max(p + side, 0.0), 1.0) for p in fractions.values() for side in (-reach, reach)})
    cuts = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.percentile_approx(value, F.array(*[F.lit(p) for p in cut_at]), F.lit(SKETCH)).alias("__cuts")
    )
    cuts = stored(cuts.withColumn("__cuts", F.array_sort("__cuts")), f"{work}/cuts")
    low = lambda i: F.get("__cuts", F.lit(i))
    bin_of = sum((F.when(low(i) < F.col(value), 1).otherwise(0) for i in range(len(cut_at))), F.lit(0))
    histogram = (
        df.filter(F.col(value).isNotNull()).join(cuts, keys).withColumn("__bin", bin_of)
        .groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__in_bin"))
    )
    upto = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.explode(
        F.array(*[F.struct(F.lit(k).alias("stat"), F.lit(p).alias("p")) for k, p in fractions.items()])
    )
    targets = (
        histogram.withColumn("__upto", F.sum("__in_bin").over(upto))
        .withColumn("__total", F.sum("__in_bin").over(Window.partitionBy(*keys)))
        .withColumn("__want", wanted)
        .withColumn("__at", F.least(F.floor(F.col("__total") * F.col("__want.p")), F.col("__total") - 1))
        .filter((F.col("__at") < F.col("__upto")) & (F.col("__at") >= F.col("__upto") - F.col("__in_bin")))
        .groupBy(*keys, "__bin").agg(
            F.collect_list(
                F.struct(F.col("__want.stat").alias("stat"), (F.col("__at") - (F.col("__upto") - F.col("__in_bin"))).alias("offset"))
            ).alias("__stats")
        )
    )
    # A range lies above one cut and reaches to the next; the outer ones are open.
    ranges = targets.join(cuts, keys).select(
        *keys, "__bin", "__stats", low(F.col("__bin") - 1).alias("__above"), low(F.col("__bin")).alias("__to"),
    )
    ranges = stored(ranges, f"{work}/ranges")
    inside = (
        Window.partitionBy(*keys, "__bin").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    within = F.coalesce(F.col(value) > F.col("__above"), F.lit(True)) & F.coalesce(F.col(value) <= F.col("__to"), F.lit(True))
    ranked = (
        df.filter(F.col(value).isNotNull()).join(ranges.drop("__stats"), keys).filter(within)
        .groupBy(*keys, "__bin", value).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__seen", F.sum("__n").over(inside))
    )
    return (
        ranked.join(ranges.select(*keys, "__bin", F.explode("__stats").alias("__stat")), [*keys, "__bin"])
        .filter((F.col("__stat.offset") < F.col("__seen")) & (F.col("__stat.offset") >= F.col("__seen") - F.col("__n")))
        .select(*keys, F.col("__stat.stat").alias("stat"), F.col(value).alias("value"))
    )


def numbered(df: DataFrame, keys: Sequence[str], coarse: Column, order: Sequence[Column]) -> DataFrame:
    """Add ``position`` (1-based) within each key, for keys of any size.

    ``coarse`` must sort like the start of ``order``. Rows are numbered inside
    each (key, coarse) group and shifted by the sizes of the groups before it,
    so one large key is numbered by many tasks.
    """
    keys = list(keys)
    rows = df.withColumn("__coarse", coarse)
    sizes = rows.groupBy(*keys, "__coarse").agg(F.count(F.lit(1)).alias("__size"))
    before = (
        Window.partitionBy(*keys).orderBy("__coarse")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *keys, "__coarse", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(*keys, "__coarse").orderBy(*order)
    return (
        rows.withColumn("__inside", F.row_number().over(inside))
        .join(offsets, [*keys, "__coarse"])
        .withColumn("position", F.col("__before") + F.col("__inside"))
        .drop("__coarse", "__inside", "__before")
    )
