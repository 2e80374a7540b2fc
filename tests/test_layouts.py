"""Stored layouts: cells of boxes, pages of ranges, counts kept up to date."""

import random

import pytest
from pyspark.sql import functions as F

from leadlake.operators import layouts


def brute_key(x, y):
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(layouts.BITS))


def test_cell_keys_interleave_bits(spark):
    rng = random.Random(1)
    points = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(200)] + [(-180.0, -90.0), (180.0, 90.0), (0.0, 0.0), (None, 1.0), (500.0, -500.0)]
    got = spark.createDataFrame(points, "lng double, lat double").select("lng", "lat", layouts.cell_key(F.col("lng"), F.col("lat")).alias("k")).collect()
    for r in got:
        want = None if r["lng"] is None else brute_key(layouts._cell_of(r["lng"], -180, 360), layouts._cell_of(r["lat"], -90, 180))
        assert r["k"] == want


def test_intervals_hold_every_point_of_a_box():
    rng = random.Random(2)
    for _ in range(60):
        west, south = rng.uniform(-180, 179), rng.uniform(-90, 89)
        box = (west, south, min(180, west + 10 ** rng.uniform(-3, 2)), min(90, south + 10 ** rng.uniform(-3, 1.9)))
        intervals = layouts.box_intervals(box)
        assert 0 < len(intervals) <= layouts.INTERVALS and all(a <= b for a, b in intervals)
        for _ in range(50):
            lng, lat = rng.uniform(box[0], box[2]), rng.uniform(box[1], box[3])
            key = brute_key(layouts._cell_of(lng, -180, 360), layouts._cell_of(lat, -90, 180))
            assert any(a <= key <= b for a, b in intervals)


def test_a_box_reads_few_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "t")
    points = spark.range(200_000).select(
        "id", (73 + (F.col("id") * 7919 % 62_003) / 1000.0).alias("lng"), (18 + (F.col("id") * 104_729 % 35_999) / 1000.0).alias("lat"), F.md5(F.col("id").cast("string")).alias("pad"),
    )
    layouts.write_spatial(points, path, 8, group_bytes=64 << 10)
    box = (120.0, 30.0, 120.6, 30.5)
    found = layouts.in_box_cells(spark.read.parquet(path), box)
    want = points.filter(F.col("lng").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in want.collect()) and found.count()
    intervals, total, read = layouts.box_intervals(box), 0, 0
    for file in (tmp_path / "t").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        column = meta.schema.names.index(layouts.CELL)
        for group in range(meta.num_row_groups):
            stats = meta.row_group(group).column(column).statistics
            total += 1
            read += any(stats.min <= high and low <= stats.max for low, high in intervals)
    assert total > 20 and 0 < read < total / 10
    assert layouts.CELL in found._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1][:400]


def test_any_page_reads_one_or_two_ranges(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, *range(20)])) for i in range(997)]
    table = layouts.PagedTable(str(tmp_path), (F.desc_nulls_last("v"), F.asc("k")))
    table.create(spark.createDataFrame(rows, "k int, v int"), 16)
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for number in (1, 2, 25, 50, 99, 100, 101):
        assert [tuple(r) for r in table.page(spark, number, 10).collect()] == order[(number - 1) * 10 : number * 10]
        chosen, _ = table.ranges_of(spark, (number - 1) * 10, 10)
        assert len(chosen) <= 2
    assert table.total(spark).first()[0] == 997
    with pytest.raises(ValueError):
        table.page(spark, 0, 10)


def test_counts_after_inserts_edits_and_deletions(spark):
    schema = "dim string, k string, n long"
    counts = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 2)], schema)
    before = spark.createDataFrame([("a", "y", 1), ("b", "x", 1)], schema)
    after = spark.createDataFrame([("a", "z", 2), ("b", "x", 1)], schema)
    got = sorted(map(tuple, layouts.changed_counts(counts, ["dim", "k"], before, after).collect()))
    assert got == [("a", "x", 3), ("a", "z", 2), ("b", "x", 2)]
