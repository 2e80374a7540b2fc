"""Distances, bounding boxes and reproducible scatter around a centre point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.fixed_values import (
    CITY_CENTRES,
    EARTH_RADIUS_M,
    METRES_PER_DEGREE,
    PROVINCE_CENTRES,
    short_region,
)
from leadlake.functions.text import lookup


def haversine_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(a))


def lng_metres(lat: Column) -> Column:
    """Metres per degree of longitude, not below a fifth of the equator's."""
    return METRES_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(0.2))


def jittered(code: Column, lng: Column, lat: Column, metres: float = 120.0) -> Column:
    """struct(lng, lat): the centre moved by up to ``metres``, fixed by the code.

    Companies placed at one street centre would otherwise hide each other.
    """
    seed = F.conv(F.substring(F.md5(code), 1, 8), 16, 10).cast("long")
    east = (seed % 1000 / F.lit(999.0) - 0.5) * 2 * metres
    north = (F.floor(seed / 1000) % 1000 / F.lit(999.0) - 0.5) * 2 * metres
    return F.struct(
        F.round(lng + east / lng_metres(lat), 6).alias("lng"),
        F.round(lat + north / METRES_PER_DEGREE, 6).alias("lat"),
    )


def in_box(lng: Column, lat: Column, box) -> Column:
    """box = (min_lng, min_lat, max_lng, max_lat), edges included."""
    return lng.between(box[0], box[2]) & lat.between(box[1], box[3])


def region_centre(city: Column, province: Column) -> Column:
    """struct(lat, lng) of a known city (with or without '市'), else of the province."""
    full = F.concat(F.replace(city, F.lit("市"), F.lit("")), F.lit("市"))
    by_province = PROVINCE_CENTRES | {short_region(k): p for k, p in PROVINCE_CENTRES.items()}

    def coordinate(i: int) -> Column:
        cities = {k: str(p[i]) for k, p in CITY_CENTRES.items()}
        provinces = {k: str(p[i]) for k, p in by_province.items()}
        return F.coalesce(
            lookup(cities, city, "double"), lookup(cities, full, "double"),
            lookup(provinces, province, "double"),
        )

    return F.struct(coordinate(0).alias("lat"), coordinate(1).alias("lng"))
