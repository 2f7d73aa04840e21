"""Map projections as column expressions (WGS 84, Web Mercator, UTM)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from groundcheck.fixed_values import ZOOM0_RESOLUTION

_EARTH = 6378137.0
_FLATTENING = 1 / 298.257223563
_N = _FLATTENING / (2 - _FLATTENING)
_SCALE = 0.9996 * _EARTH / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ECC = 2 * math.sqrt(_N) / (1 + _N)
# Kruger series, third order in the third flattening
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
    7 * _N**2 / 3 - 8 * _N**3 / 5,
    56 * _N**3 / 15,
)
_MERCATOR_HALF = math.pi * _EARTH


def utm_zone(lon: Column) -> Column:
    """UTM zone number, clamped to 1-60."""
    return F.greatest(F.lit(1), F.least(F.lit(60), (F.floor((lon + 180.0) / 6.0) + 1).cast("int")))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the local UTM zone."""
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


def _points(points: Column, **fields) -> Column:
    """One pass over an array of points; staging keeps each intermediate evaluated once."""
    return F.transform(points, lambda p: F.struct(*[f(p).alias(k) for k, f in fields.items()]))


def utm_forward_points(points: Column, zone: int, south: bool = False) -> Column:
    """Project an array of ``struct<x lon, y lat>`` to UTM metres."""
    central = zone * 6.0 - 183.0
    staged = _points(
        points,
        t=lambda p: F.sinh(
            F.atanh(F.sin(F.radians(p["y"]))) - _ECC * F.atanh(_ECC * F.sin(F.radians(p["y"])))),
        d=lambda p: F.radians(p["x"] - central),
    )
    staged = _points(
        staged,
        xi=lambda p: F.atan2(p["t"], F.cos(p["d"])),
        eta=lambda p: F.atanh(F.sin(p["d"]) / F.sqrt(1 + p["t"] * p["t"])),
    )

    def easting(p: Column) -> Column:
        total = p["eta"]
        for j, a in enumerate(_ALPHA, start=1):
            total = total + a * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
        return 500000.0 + _SCALE * total

    def northing(p: Column) -> Column:
        total = p["xi"]
        for j, a in enumerate(_ALPHA, start=1):
            total = total + a * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
        return (10000000.0 if south else 0.0) + _SCALE * total

    return _points(staged, x=easting, y=northing)


def utm_inverse_points(points: Column, zone: int, south: bool = False) -> Column:
    """Back from UTM metres to ``struct<x lon, y lat>``."""
    central = zone * 6.0 - 183.0
    false_north = 10000000.0 if south else 0.0
    staged = _points(
        points,
        xi=lambda p: (p["y"] - false_north) / _SCALE,
        eta=lambda p: (p["x"] - 500000.0) / _SCALE,
    )

    def xi(p: Column) -> Column:
        total = p["xi"]
        for j, b in enumerate(_BETA, start=1):
            total = total - b * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
        return total

    def eta(p: Column) -> Column:
        total = p["eta"]
        for j, b in enumerate(_BETA, start=1):
            total = total - b * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
        return total

    staged = _points(staged, xi=xi, eta=eta)
    staged = _points(
        staged,
        chi=lambda p: F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])),
        lon=lambda p: F.degrees(F.atan2(F.sinh(p["eta"]), F.cos(p["xi"]))) + central,
    )

    def lat(p: Column) -> Column:
        total = p["chi"]
        for j, d in enumerate(_DELTA, start=1):
            total = total + d * F.sin(2 * j * p["chi"])
        return F.degrees(total)

    return _points(staged, x=lambda p: p["lon"], y=lat)


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / _EARTH)


def mercator_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / _EARTH)) - math.pi / 2)


def mercator_x(lon: Column) -> Column:
    return _EARTH * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return _EARTH * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def mercator_to_wgs84_points(points: Column) -> Column:
    return _points(points, x=lambda p: mercator_lon(p["x"]), y=lambda p: mercator_lat(p["y"]))


def wgs84_to_mercator_points(points: Column) -> Column:
    return _points(points, x=lambda p: mercator_x(p["x"]), y=lambda p: mercator_y(p["y"]))


def wgs84_bounds(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Bounds in degrees as ``struct<south,west,north,east>``; null when not on the globe."""
    w, e = mercator_lon(minx), mercator_lon(maxx)
    s, n = mercator_lat(miny), mercator_lat(maxy)
    box = F.struct(
        F.least(s, n).alias("south"), F.least(w, e).alias("west"),
        F.greatest(s, n).alias("north"), F.greatest(w, e).alias("east"))
    usable = F.lit(True)
    for v, limit in ((s, 90.0), (n, 90.0), (w, 180.0), (e, 180.0)):
        usable = usable & ~F.isnan(v) & (F.abs(v) <= limit)
    return F.when(usable, box)


def native_zoom(gsd_x: Column, gsd_y: Column) -> Column:
    """Web-map zoom whose pixel matches the finer resolution; 21 when neither is usable."""

    def usable(v: Column) -> Column:
        return F.when(~F.isnan(v) & (v > 0) & (v < float("inf")), v)

    finest = F.least(usable(gsd_x), usable(gsd_y))
    zoom = F.bround(F.log2(ZOOM0_RESOLUTION / finest)).cast("int")
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(24), zoom)), F.lit(21))


def xyz_bounds(z: Column, x: Column, y: Column) -> Column:
    """Web-map tile bounds in Web Mercator metres."""
    span = 2 * _MERCATOR_HALF / F.pow(F.lit(2.0), z)
    return F.struct(
        (x * span - _MERCATOR_HALF).alias("minx"),
        (_MERCATOR_HALF - (y + 1) * span).alias("miny"),
        ((x + 1) * span - _MERCATOR_HALF).alias("maxx"),
        (_MERCATOR_HALF - y * span).alias("maxy"))


def xyz_tile(z: Column, mx: Column, my: Column) -> Column:
    """The web-map tile holding a Web Mercator point: the partition key of a tiled layer."""
    span = 2 * _MERCATOR_HALF / F.pow(F.lit(2.0), z)
    return F.struct(
        F.floor((mx + _MERCATOR_HALF) / span).alias("x"),
        F.floor((_MERCATOR_HALF - my) / span).alias("y"))


def resampling_parameters(source_gsd: Column, lat: Column, target_gsd: Column) -> Column:
    """Ground resolution of a Web Mercator pixel and its ratio to the target resolution."""
    ground = source_gsd * F.abs(F.cos(F.radians(lat)))
    factor = ground / target_gsd
    usable = (source_gsd > 0) & (target_gsd > 0) & lat.between(-90, 90)
    return F.when(usable, F.struct(
        ground.alias("source_ground_resolution_m"),
        target_gsd.alias("target_resolution_m"),
        factor.alias("resampling_factor"),
        (1.0 / factor).alias("downsample_factor"),
        (ground > 1.5 * target_gsd).alias("coarse_source")))


def pixel_to_map(a, b, c, d, e, f, col: Column, row: Column) -> Column:
    """Affine pixel corner to map coordinates."""
    return F.struct((a * col + b * row + c).alias("x"), (d * col + e * row + f).alias("y"))


def map_to_pixel(a, b, c, d, e, f, x: Column, y: Column) -> Column:
    """Inverse of :func:`pixel_to_map`."""
    det = a * e - b * d
    dx, dy = x - c, y - f
    return F.struct(
        ((e * dx - b * dy) / det).alias("col"), ((a * dy - d * dx) / det).alias("row"))
