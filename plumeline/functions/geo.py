"""Geometry on longitude and latitude as Column expressions; no Python runs on executors.

Coordinates are (lon, lat) in degrees, WGS84. Constants differ by use and stay apart: great circles
use EARTH_KM, local planes KM_PER_DEG, drift steps M_PER_DEG.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_KM = 6371.0088
KM_PER_DEG = 111.32
M_PER_DEG = 111320.0
KM_PER_KNOT_HOUR = 1.852


def _c(x: Column | float | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine_km(lon1, lat1, lon2, lat2) -> Column:  # noqa: ANN001
    """Great-circle distance in km."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    up, side = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * side * side
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing_deg(lon1, lat1, lon2, lat2) -> Column:  # noqa: ANN001
    """Initial bearing from the first point to the second, clockwise from north, in [0, 360)."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    turn = F.radians(lon2 - lon1)
    y = F.sin(turn) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def angle_between_deg(a, b) -> Column:  # noqa: ANN001
    """The smaller angle between two directions, 0 to 180."""
    return F.abs(F.pmod(_c(a) - _c(b) + 180.0, F.lit(360.0)) - 180.0)


def local_xy_km(lon, lat, lon0, lat0) -> tuple[Column, Column]:  # noqa: ANN001
    """East and north km from an origin, on the plane that touches there."""
    lon, lat, lon0, lat0 = map(_c, (lon, lat, lon0, lat0))
    return (lon - lon0) * KM_PER_DEG * F.cos(F.radians(lat0)), (lat - lat0) * KM_PER_DEG


def segment_km(lon, lat, lon1, lat1, lon2, lat2) -> tuple[Column, Column]:  # noqa: ANN001
    """Distance of a point to a segment, and how far along it the nearest place lies, 0 to 1.

    The plane touches at the point. A segment of no length is its first end.
    """
    ax, ay = local_xy_km(lon1, lat1, lon, lat)
    bx, by = local_xy_km(lon2, lat2, lon, lat)
    dx, dy = bx - ax, by - ay
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.nullif(long, F.lit(0.0))))).otherwise(0.0)
    plane = F.hypot(ax + t * dx, ay + t * dy)
    return F.when(long > 0, plane).otherwise(haversine_km(lon, lat, lon1, lat1)), t


def metres_to_degrees(dx, dy, lat) -> tuple[Column, Column]:  # noqa: ANN001
    """Degrees of longitude and latitude of a step in metres at a latitude; near the poles cos is held at 1e-6."""
    return _c(dx) / (F.greatest(F.cos(F.radians(_c(lat))), F.lit(1e-6)) * M_PER_DEG), _c(dy) / M_PER_DEG


def degrees_to_metres(dlon, dlat, lat) -> tuple[Column, Column]:  # noqa: ANN001
    return _c(dlon) * F.greatest(F.cos(F.radians(_c(lat))), F.lit(1e-6)) * M_PER_DEG, _c(dlat) * M_PER_DEG


def wrap_lon(lon) -> Column:  # noqa: ANN001
    """Longitude in [-180, 180)."""
    return F.pmod(_c(lon) + 180.0, F.lit(360.0)) - 180.0


def displacement_km(lon1, lat1, lon2, lat2) -> Column:  # noqa: ANN001
    """Length of a drift step, on the plane at its mean latitude."""
    dx, dy = degrees_to_metres(wrap_lon(_c(lon2) - _c(lon1)), _c(lat2) - _c(lat1), (_c(lat1) + _c(lat2)) / 2)
    return F.hypot(dx, dy) / 1000.0


def edge_distance_km(lon, lat, west, south, east, north) -> Column:  # noqa: ANN001
    """Distance of a point to the nearest side of a box; negative outside."""
    lon, lat = _c(lon), _c(lat)
    wide = F.greatest(F.cos(F.radians(lat)), F.lit(1e-6)) * M_PER_DEG
    return F.least((lon - _c(west)) * wide, (_c(east) - lon) * wide, (lat - _c(south)) * M_PER_DEG, (_c(north) - lat) * M_PER_DEG) / 1000.0


def offset_point(lon, lat, km, bearing) -> tuple[Column, Column]:  # noqa: ANN001
    """The point some km away in a direction, on the local plane."""
    lat, way = _c(lat), F.radians(_c(bearing))
    return _c(lon) + _c(km) * F.sin(way) / (F.cos(F.radians(lat)) * KM_PER_DEG), lat + _c(km) * F.cos(way) / KM_PER_DEG


def pixel_km(west, south, east, north, width, height) -> tuple[Column, Column]:  # noqa: ANN001
    """Width and height in km of a pixel of an image over a box."""
    west, south, east, north = map(_c, (west, south, east, north))
    mid = (south + north) / 2
    return haversine_km(west, mid, east, mid) / _c(width), haversine_km(west, south, west, north) / _c(height)


def ring_area_km2(ring: Column, lon: str = "lon", lat: str = "lat") -> Column:
    """Shoelace area of a ring given as an array of structs; the ring may be closed or open."""
    n = F.size(ring)
    mid = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[lat]) / n
    twice = F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0.0),
        lambda s, i: s + F.element_at(ring, i + 1)[lon] * F.element_at(ring, (i + 1) % n + 1)[lat] - F.element_at(ring, (i + 1) % n + 1)[lon] * F.element_at(ring, i + 1)[lat],
    )
    return F.when(n >= 3, F.abs(twice) / 2 * KM_PER_DEG * KM_PER_DEG * F.cos(F.radians(mid)))


def circle(lon, lat, km, segments: int = 96) -> Column:  # noqa: ANN001
    """A closed ring about a point, counted from north clockwise."""
    def at(k: Column) -> Column:
        x, y = offset_point(lon, lat, km, k * (360.0 / segments))
        return F.struct(x.alias("lon"), y.alias("lat"))
    return F.transform(F.sequence(F.lit(0), F.lit(segments)), at)


def ellipse(lon, lat, semi_major_km, semi_minor_km, axis_deg, segments: int = 64) -> Column:  # noqa: ANN001
    """A closed elliptic ring whose long axis has the bearing axis_deg."""
    turn = F.radians(_c(axis_deg))

    def at(k: Column) -> Column:
        t = k * F.lit(2 * 3.141592653589793 / segments)
        along, across = _c(semi_major_km) * F.cos(t), _c(semi_minor_km) * F.sin(t)
        x, y = along * F.sin(turn) + across * F.cos(turn), along * F.cos(turn) - across * F.sin(turn)
        return F.struct((_c(lon) + x / (F.cos(F.radians(_c(lat))) * KM_PER_DEG)).alias("lon"), (_c(lat) + y / KM_PER_DEG).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(segments)), at)


def likely_swapped(lon, lat, west, south, east, north) -> Column:  # noqa: ANN001
    """True for a point outside a box that would lie inside with its coordinates exchanged."""
    lon, lat = _c(lon), _c(lat)
    inside = lambda x, y: x.between(_c(west), _c(east)) & y.between(_c(south), _c(north))
    return ~inside(lon, lat) & inside(lat, lon)
