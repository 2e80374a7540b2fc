"""Companies around points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.fixed_values import METRES_PER_DEGREE
from leadlake.functions.geo import haversine_m, in_box, lng_metres
from leadlake.operators.ranking import top_per_key

CELL_DEGREES = 0.25
#: Grids for the nearest companies: each divides a cell of the one before into 16.
GRIDS = 7


def reach_box(lng: float, lat: float, radius_m: float) -> tuple[float, float, float, float]:
    """A box (west, south, east, north) around all points within the radius."""
    d_lat = radius_m / METRES_PER_DEGREE
    d_lng = radius_m / (METRES_PER_DEGREE * max(math.cos(math.radians(lat)), 0.2))
    return lng - d_lng, lat - d_lat, lng + d_lng, lat + d_lat


def around(companies: DataFrame, lng: float, lat: float, radius_m: float) -> DataFrame:
    """Companies within the radius of one point, with ``distance_m``.

    The bounding box is a pair of range filters that reach the scan.
    """
    box = reach_box(lng, lat, radius_m)
    distance = haversine_m(F.lit(lng), F.lit(lat), F.col("lng"), F.col("lat"))
    near = companies.filter(in_box(F.col("lng"), F.col("lat"), box)).withColumn("__m", distance)
    return (
        near.filter(F.col("__m") <= radius_m)
        .withColumn("distance_m", F.round("__m").cast("long")).drop("__m")
    )


def _cell(c: Column) -> Column:
    return F.floor(c / CELL_DEGREES)


def radius_pairs(centres: DataFrame, companies: DataFrame) -> DataFrame:
    """(centre_id, company columns, distance_m) for centres (centre_id, lng, lat, radius_m).

    Centres are copied to every grid cell their box touches and joined to the
    companies of that cell by equality. A crowded cell is split by adaptive
    execution on the company side.
    """
    d_lat = F.col("radius_m") / METRES_PER_DEGREE
    d_lng = F.col("radius_m") / lng_metres(F.col("c_lat"))
    placed = centres.select(
        "centre_id", F.col("lng").alias("c_lng"), F.col("lat").alias("c_lat"), "radius_m"
    )
    cells = placed.withColumn(
        "cell_x", F.explode(F.sequence(_cell(F.col("c_lng") - d_lng), _cell(F.col("c_lng") + d_lng)))
    ).withColumn(
        "cell_y", F.explode(F.sequence(_cell(F.col("c_lat") - d_lat), _cell(F.col("c_lat") + d_lat)))
    )
    located = companies.filter(F.col("lng").isNotNull() & F.col("lat").isNotNull()).withColumns(
        {"cell_x": _cell(F.col("lng")), "cell_y": _cell(F.col("lat"))}
    )
    in_reach = (F.abs(F.col("lat") - F.col("c_lat")) <= d_lat) & (
        F.abs(F.col("lng") - F.col("c_lng")) <= d_lng
    )
    pairs = located.join(cells, ["cell_x", "cell_y"]).filter(in_reach)
    distance = haversine_m(F.col("c_lng"), F.col("c_lat"), F.col("lng"), F.col("lat"))
    return (
        pairs.withColumn("__m", distance).filter(F.col("__m") <= F.col("radius_m"))
        .withColumn("distance_m", F.round("__m").cast("long"))
        .drop("__m", "cell_x", "cell_y", "c_lng", "c_lat", "radius_m")
    )


def _grid(c: Column, grid: Column) -> Column:
    return F.floor(c / CELL_DEGREES * F.pow(F.lit(4.0), grid)).cast("long")


def _grid_metres(grid: Column) -> Column:
    return METRES_PER_DEGREE * CELL_DEGREES / F.pow(F.lit(4.0), grid)


def nearest(centres: DataFrame, companies: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` nearest companies of each centre within its radius, by whole metres, then by ``key``.

    Centres are (centre_id, lng, lat, radius_m). Of one point only the ``n`` first keys can be
    among the nearest. The finest grid that has ``n`` companies in the nine cells around a
    centre bounds how far they can be, so a centre meets only the companies of the cells that
    this bound touches, however many lie within its radius.
    """
    located = companies.filter(F.col("lng").isNotNull() & F.col("lat").isNotNull())
    located = top_per_key(located, ["lng", "lat"], [F.asc(key)], n)
    grid = F.explode(F.sequence(F.lit(0), F.lit(GRIDS - 1)))
    cells = {"cell_x": _grid(F.col("lng"), F.col("grid")), "cell_y": _grid(F.col("lat"), F.col("grid"))}
    filed = located.withColumn("grid", grid).withColumns(cells)
    counts = filed.groupBy("grid", "cell_x", "cell_y").agg(F.count(F.lit(1)).alias("__n"))
    centres = centres.filter(F.col("radius_m").isNotNull())
    points = centres.select("lng", "lat").distinct()
    beside = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)]))
    looked = points.withColumn("grid", grid).withColumns(cells).withColumn("__by", beside).withColumns(
        {"cell_x": F.col("cell_x") + F.col("__by.x"), "cell_y": F.col("cell_y") + F.col("__by.y")}
    )
    enough = looked.join(counts, ["grid", "cell_x", "cell_y"]).groupBy("lng", "lat", "grid").agg(F.sum("__n").alias("__n"))
    finest = enough.filter(F.col("__n") >= n).groupBy("lng", "lat").agg(F.max("grid").alias("grid"))
    # Two cells each way hold the nine; half a metre each way is lost in whole metres.
    bound = F.when(F.col("grid").isNotNull(), _grid_metres(F.col("grid")) * 2.9 + 2)
    reached = centres.join(finest, ["lng", "lat"], "left").select(
        "centre_id", F.col("lng").alias("c_lng"), F.col("lat").alias("c_lat"),
        F.least(F.col("radius_m"), bound).alias("__reach"),
    )
    # The finest grid whose cells are not much smaller than the reach.
    fitting = F.floor(F.log(4.0, _grid_metres(F.lit(0)) * 3 / F.greatest("__reach", F.lit(1))))
    reached = reached.withColumn("grid", F.greatest(F.lit(0), F.least(F.lit(GRIDS - 1), fitting)).cast("int"))
    d_lat = F.col("__reach") / METRES_PER_DEGREE
    d_lng = F.col("__reach") / lng_metres(F.col("c_lat")) * 1.02
    spans = {"cell_x": (F.col("c_lng"), d_lng), "cell_y": (F.col("c_lat"), d_lat)}
    touched = reached
    for cell, (at, reach) in spans.items():
        touched = touched.withColumn(cell, F.explode(F.sequence(_grid(at - reach, F.col("grid")), _grid(at + reach, F.col("grid")))))
    pairs = filed.join(touched, ["grid", "cell_x", "cell_y"])
    metres = haversine_m(F.col("c_lng"), F.col("c_lat"), F.col("lng"), F.col("lat"))
    pairs = pairs.withColumn("__m", metres).filter(F.col("__m") <= F.col("__reach"))
    pairs = pairs.withColumn("distance_m", F.round("__m").cast("long"))
    dropped = ("__m", "__reach", "grid", "cell_x", "cell_y", "c_lng", "c_lat")
    return top_per_key(pairs.drop(*dropped), ["centre_id"], [F.asc("distance_m"), F.asc(key)], n)


def count_around(centres: DataFrame, companies: DataFrame) -> DataFrame:
    """(centre_id, n, with_mobile): companies within each centre's radius."""
    pairs = radius_pairs(centres, companies.select("lng", "lat", "has_mobile"))
    counts = pairs.groupBy("centre_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("has_mobile").alias("with_mobile")
    )
    return centres.select("centre_id").join(counts, "centre_id", "left").fillna(0)
