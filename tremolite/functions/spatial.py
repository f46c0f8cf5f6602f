"""Grid snapping, distances and containment as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DEG_KM = 111.32
EARTH_RADIUS_KM = 6371.0

# Tectonic zones in priority order (name, lat_min, lat_max, lon_min, lon_max), closed edges.
ZONES = [
    ("tohoku_offshore", 35, 42, 140, 148),
    ("kanto_tokai", 33, 36, 137, 142),
    ("nankai", 30, 35, 130, 137),
    ("kyushu", 28, 34, 128, 133),
    ("hokkaido", 41, 46, 140, 148),
    ("izu_bonin", 26, 35, 138, 145),
]


def cell_index(x: Column, size: float) -> Column:
    """Nearest cell number, half to even, as an integer key (float keys do not join safely)."""
    return F.bround(x / F.lit(float(size))).cast("int")


def snap(x: Column, size: float, mode: str = "nearest_even", origin: float = 0.0) -> Column:
    """`nearest_even` and `floor_center` give a coordinate, `index` gives a row/column number from `origin`."""
    size = float(size)
    if mode == "nearest_even":
        return F.bround(x / F.lit(size)) * F.lit(size)
    if mode == "floor_center":
        return F.floor(x / F.lit(size)) * F.lit(size) + F.lit(size / 2)
    if mode == "index":
        return F.floor((x - F.lit(float(origin))) / F.lit(size)).cast("int")
    raise ValueError(f"unknown snap mode {mode}")


def cell_center(index: Column, size: float, origin: float = 0.0) -> Column:
    return F.lit(float(origin)) + (index + F.lit(0.5)) * F.lit(float(size))


def within_box(lat1: Column, lon1: Column, lat2: Column, lon2: Column, r: float) -> Column:
    return (F.abs(lat1 - lat2) <= F.lit(float(r))) & (F.abs(lon1 - lon2) <= F.lit(float(r)))


def degree_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance in degrees, longitude shrunk by cos(lat1)."""
    dlon = (lon1 - lon2) * F.cos(F.radians(lat1))
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + dlon * dlon)


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dy = (lat1 - lat2) * F.lit(DEG_KM)
    dx = (lon1 - lon2) * F.lit(DEG_KM) * F.cos(F.radians(lat1))
    return F.sqrt(dy * dy + dx * dx)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def azimuth_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from point 1 to point 2 in [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + F.lit(360.0), F.lit(360.0))


def zone_of(lat: Column, lon: Column, zones=None, closed: bool = True, other: str | None = "other") -> Column:
    """First matching box of a fixed, ordered list of boxes; the list is code, never data."""
    expr = None
    for name, lat0, lat1, lon0, lon1 in zones or ZONES:
        if closed:
            hit = lat.between(lat0, lat1) & lon.between(lon0, lon1)
        else:
            hit = (lat >= lat0) & (lat < lat1) & (lon >= lon0) & (lon < lon1)
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise(F.lit(other))


def in_any_box(lat: Column, lon: Column, boxes) -> Column:
    hit = F.lit(False)
    for lat0, lat1, lon0, lon1 in boxes:
        hit = hit | (lat.between(lat0, lat1) & lon.between(lon0, lon1))
    return hit


def sinusoidal_tile(h: Column, v: Column, row: Column, col: Column, size: int):
    """Latitude and longitude of a pixel centre of a 36 x 18 sinusoidal tile grid."""
    lat = F.lit(90.0) - (v + (row + F.lit(0.5)) / F.lit(float(size))) * F.lit(10.0)
    x = (h + (col + F.lit(0.5)) / F.lit(float(size))) * F.lit(10.0) - F.lit(180.0)
    return lat, F.try_divide(x, F.cos(F.radians(lat)))


def horizontal_norm(*parts: Column) -> Column:
    total = None
    for p in parts:
        total = p * p if total is None else total + p * p
    return F.sqrt(total)
