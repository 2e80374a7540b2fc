"""Layouts of stored tables: rows near each other on the map, and rows in the order of their pages.

Spatial. Coordinates become one cell key whose bits alternate between longitude and
latitude. Files are range-written by it, so a row group covers a small area. A box becomes
a few intervals of keys, which reach the scan and rule row groups out; an exact test on
the coordinates follows.

Pages. Rows are range-written by an order, and the rows of each range are counted once.
A page number then names the one or two ranges that hold it: only these are read and
sorted, whatever the number.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.functions.geo import in_box

CELL, PART = "cell_key", "page_part"
#: Bits of each coordinate in a cell key, and the most intervals that a box becomes.
BITS, INTERVALS = 16, 24
#: Shifts and masks that put a zero between the bits of a number.
SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))
Box = tuple[float, float, float, float]


# --- cells ---------------------------------------------------------------------


def _scaled(value: Column, low: float, span: float) -> Column:
    top = (1 << BITS) - 1
    return F.least(F.greatest(F.floor((value - low) / span * (1 << BITS)), F.lit(0)), F.lit(top)).cast("long")


def _spread(number: Column) -> Column:
    for shift, mask in SPREAD:
        number = number.bitwiseOR(F.shiftleft(number, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return number


def cell_key(lng: Column, lat: Column) -> Column:
    """The cell of a point; null without both coordinates."""
    key = _spread(_scaled(lng, -180, 360)).bitwiseOR(F.shiftleft(_spread(_scaled(lat, -90, 180)), 1))
    return F.when(lng.isNotNull() & lat.isNotNull(), key)


def _cell_of(value: float, low: float, span: float) -> int:
    return min(max(int((value - low) // (span / (1 << BITS))), 0), (1 << BITS) - 1)


def box_intervals(box: Box, most: int = INTERVALS) -> list[tuple[int, int]]:
    """At most ``most`` intervals of cell keys that hold every point of a box (west, south, east, north).

    Squares of the grid are divided while they cross the border of the box, the largest
    first, until there are enough of them; what is left of the border is taken whole.
    """
    # A cell more on each side, whatever the rounding of the border.
    west, east = (max(_cell_of(box[0], -180, 360) - 1, 0), min(_cell_of(box[2], -180, 360) + 1, (1 << BITS) - 1))
    south, north = (max(_cell_of(box[1], -90, 180) - 1, 0), min(_cell_of(box[3], -90, 180) + 1, (1 << BITS) - 1))
    done: list[tuple[int, int]] = []
    # Squares of one level (x, y, key of the first cell) that meet the box.
    level, open_ = BITS, [(0, 0, 0)]
    while open_:
        size, border = 1 << level, []
        for x, y, key in open_:
            if x > east or y > north or x + size <= west or y + size <= south:
                continue
            if level == 0 or (west <= x and x + size - 1 <= east and south <= y and y + size - 1 <= north):
                done.append((key, key + (1 << 2 * level) - 1))
            else:
                border.append((x, y, key))
        if len(_merged([*done, *[(k, k + (1 << 2 * level) - 1) for _, _, k in border]])) * 2 > most or level == 0:
            done += [(k, k + (1 << 2 * level) - 1) for _, _, k in border]
            break
        half, quarter = size >> 1, 1 << 2 * (level - 1) if level else 0
        open_ = [
            (x + dx * half, y + dy * half, key + (dx + 2 * dy) * quarter) for x, y, key in border for dy in (0, 1) for dx in (0, 1)
        ]
        level -= 1
    merged = _merged(done)
    while len(merged) > most:
        gaps = [(merged[i + 1][0] - merged[i][1], i) for i in range(len(merged) - 1)]
        _, i = min(gaps)
        merged[i : i + 2] = [(merged[i][0], merged[i + 1][1])]
    return merged


def _merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(intervals):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def write_spatial(df: DataFrame, path: str, files: int, group_bytes: int = 8 << 20) -> None:
    """Rows with coordinates lng and lat, in the order of their cells; rows without come first."""
    placed = df.withColumn(CELL, cell_key(F.col("lng"), F.col("lat")))
    ordered = placed.repartitionByRange(files, CELL).sortWithinPartitions(CELL)
    ordered.write.option("parquet.block.size", group_bytes).parquet(path)


def in_box_cells(df: DataFrame, box: Box) -> DataFrame:
    """Rows of a table of ``write_spatial`` inside a box (west, south, east, north)."""
    near = reduce(lambda a, b: a | b, [F.col(CELL).between(low, high) for low, high in box_intervals(box)], F.lit(False))
    return df.filter(near & in_box(F.col("lng"), F.col("lat"), box)).drop(CELL)


# --- pages -----------------------------------------------------------------------


@dataclass(frozen=True)
class PagedTable:
    """Rows in ranges of an order, below ``path``; the order ends with a unique column."""

    path: str
    order: tuple[Column, ...]

    def create(self, df: DataFrame, ranges: int) -> None:
        spark = df.sparkSession
        ranged = df.repartitionByRange(ranges, *self.order).sortWithinPartitions(*self.order)
        ranged.withColumn(PART, F.spark_partition_id()).write.partitionBy(PART).parquet(f"{self.path}/rows")
        counts = spark.read.parquet(f"{self.path}/rows").groupBy(PART).agg(F.count(F.lit(1)).alias("rows"))
        counts.coalesce(1).write.parquet(f"{self.path}/counts")

    def ranges_of(self, spark: SparkSession, offset: int, size: int) -> tuple[list[int], int]:
        """Ranges that hold the rows from ``offset`` on, and the rows before the first of them."""
        before, chosen, skipped = 0, [], 0
        for part, rows in spark.read.parquet(f"{self.path}/counts").orderBy(PART).collect():
            if before < offset + size and before + rows > offset:
                skipped = skipped if chosen else before
                chosen.append(part)
            before += rows
        return chosen, skipped

    def page(self, spark: SparkSession, number: int, size: int) -> DataFrame:
        if number < 1 or size < 1:
            raise ValueError("page out of range")
        offset = (number - 1) * size
        chosen, skipped = self.ranges_of(spark, offset, size)
        rows = spark.read.parquet(f"{self.path}/rows").filter(F.col(PART).isin(chosen)).drop(PART)
        return rows.orderBy(*self.order).offset(offset - skipped if chosen else 0).limit(size)

    def total(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/counts").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"))


# --- counts kept up to date ----------------------------------------------------------


def changed_counts(counts: DataFrame, keys: Sequence[str], before: DataFrame, after: DataFrame, n: str = "n") -> DataFrame:
    """Stored counts after a change: minus the counts of the rows as they were, plus those as they are.

    ``before`` and ``after`` are counts of the changed rows alone (no rows before an
    insert, none after a deletion), so the work follows the change, not the table.
    Keys whose count falls to zero go.
    """
    signed = counts.select(*keys, n).unionByName(before.select(*keys, (-F.col(n)).alias(n))).unionByName(after.select(*keys, n))
    return signed.groupBy(*keys).agg(F.sum(n).alias(n)).filter(F.col(n) != 0)
