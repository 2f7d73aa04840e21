"""GeoJSON coordinates to oriented edges, and measures of one shape.

A shape is carried as an array of edges ``struct<part,ring,seq,n,x1,y1,x2,y2,areal>`` (``n`` counts the
edges of the ring).  Outer rings run
counter-clockwise and holes clockwise, so areas and moments are plain sums over edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundcheck.functions import crs

_PARSE = """
CASE {t}
 WHEN 'Polygon' THEN array(from_json({c}, 'array<array<array<double>>>'))
 WHEN 'MultiPolygon' THEN from_json({c}, 'array<array<array<array<double>>>>')
 WHEN 'LineString' THEN array(array(from_json({c}, 'array<array<double>>')))
 WHEN 'MultiLineString' THEN transform(from_json({c}, 'array<array<array<double>>>'), line -> array(line))
 WHEN 'Point' THEN array(array(array(from_json({c}, 'array<double>'))))
 WHEN 'MultiPoint' THEN transform(from_json({c}, 'array<array<double>>'), point -> array(array(point)))
END
"""

EDGE_TYPE = (
    "array<struct<part:int,ring:int,seq:int,n:int,x1:double,y1:double,x2:double,y2:double,areal:boolean>>")


def parse_rings(geom_type: str = "geom_type", coords: str = "coords_json") -> Column:
    """Coordinate text to ``array<part: array<ring: array<struct<x,y>>>>``."""
    parsed = F.expr(_PARSE.format(t=geom_type, c=coords))
    return F.transform(parsed, lambda part: F.transform(part, lambda ring: F.transform(
        ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))))


def map_points(rings: Column, convert) -> Column:
    """Apply a point-array projection to every ring."""
    return F.transform(rings, lambda part: F.transform(part, convert))


def _ring_area2(ring: Column) -> Column:
    """Twice the signed ring area, measured from its first vertex to keep precision."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    return F.aggregate(
        F.sequence(F.lit(1), F.size(ring) - 1),
        F.lit(0.0),
        lambda acc, i: acc
        + (ring[i - 1]["x"] - x0) * (ring[i]["y"] - y0)
        - (ring[i]["x"] - x0) * (ring[i - 1]["y"] - y0))


def _is_closed(ring: Column) -> Column:
    last = ring[F.size(ring) - 1]
    return (ring[0]["x"] == last["x"]) & (ring[0]["y"] == last["y"])


def _close(ring: Column) -> Column:
    return F.when(_is_closed(ring), ring).otherwise(F.concat(ring, F.array(ring[0])))


def _without_repeats(ring: Column) -> Column:
    return F.filter(ring, lambda p, i: (i == 0) | (p["x"] != ring[F.greatest(i - 1, F.lit(0))]["x"])
                    | (p["y"] != ring[F.greatest(i - 1, F.lit(0))]["y"]))


def _orient(ring: Column, index: Column) -> Column:
    area2 = _ring_area2(ring)
    wrong = F.when(index == 0, area2 < 0).otherwise(area2 > 0)
    return F.when(F.size(ring) < 2, ring).when(wrong, F.reverse(ring)).otherwise(ring)


def oriented_rings(rings: Column, areal: Column) -> Column:
    """Close polygon rings and turn them the standard way round; other shapes stay as they are."""
    closed = F.transform(rings, lambda part: F.transform(part, _close))
    clean = F.transform(closed, lambda part: F.transform(part, _without_repeats))
    turned = F.transform(clean, lambda part: F.transform(part, _orient))
    return F.when(areal, turned).otherwise(rings)


def ring_edges(rings: Column, areal: Column) -> Column:
    """All edges of a shape; a single point becomes one edge of length zero."""

    def edge(part, ring_no, seq, n, p, q):
        return F.struct(
            part.alias("part"), ring_no.alias("ring"), seq.alias("seq"), n.alias("n"),
            p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"),
            areal.alias("areal"))

    def of_ring(part_no, ring_no, ring):
        return (
            F.when(F.size(ring) == 1, F.array(edge(part_no, ring_no, F.lit(0), F.lit(1), ring[0], ring[0])))
            .when(F.size(ring) > 1, F.transform(
                F.sequence(F.lit(1), F.size(ring) - 1),
                lambda i: edge(part_no, ring_no, i - 1, F.size(ring) - 1, ring[i - 1], ring[i])))
            .otherwise(F.array().cast(EDGE_TYPE)))

    return F.flatten(F.transform(rings, lambda part, pi: F.flatten(
        F.transform(part, lambda ring, ri: of_ring(pi, ri, ring)))))


def box_edges(x0: str, y0: str, x1: str, y1: str) -> Column:
    """Edges of an axis-parallel box given by four column names."""
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    sides = ", ".join(
        f"named_struct('part', 0, 'ring', 0, 'seq', {i}, 'n', 4, "
        f"'x1', double({a[0]}), 'y1', double({a[1]}), 'x2', double({b[0]}), 'y2', double({b[1]}), "
        "'areal', true)"
        for i, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1])))
    return F.expr(f"array({sides})")


def bounds(edges: Column) -> Column:
    """``struct<minx,miny,maxx,maxy>`` of an edge array; null when it has no edge."""
    xs = F.concat(F.transform(edges, lambda e: e["x1"]), F.transform(edges, lambda e: e["x2"]))
    ys = F.concat(F.transform(edges, lambda e: e["y1"]), F.transform(edges, lambda e: e["y2"]))
    return F.when(F.size(edges) > 0, F.struct(
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
        F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy")))


def moments(edges: Column) -> Column:
    """``struct<a,x,y>``: area and first moments relative to the first vertex."""
    x0, y0 = F.get(edges, F.lit(0))["x1"], F.get(edges, F.lit(0))["y1"]

    def add(acc, e):
        xa, ya, xb, yb = e["x1"] - x0, e["y1"] - y0, e["x2"] - x0, e["y2"] - y0
        cross = xa * yb - xb * ya
        return F.struct(
            (acc["a"] + cross / 2).alias("a"),
            (acc["x"] + cross * (xa + xb) / 6).alias("x"),
            (acc["y"] + cross * (ya + yb) / 6).alias("y"))

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    areal_edges = F.filter(edges, lambda e: e["areal"])
    return F.aggregate(areal_edges, zero, add)


def area(edges: Column) -> Column:
    """Area of a shape with holes and parts; 0 for lines, points and empty shapes."""
    return F.coalesce(moments(edges)["a"], F.lit(0.0))


def centroid(edges: Column) -> Column:
    """Centroid from area moments, or the mean vertex when there is no area."""
    m = moments(edges)
    first = F.get(edges, F.lit(0))
    mean_x = F.aggregate(edges, F.lit(0.0), lambda a, e: a + e["x1"]) / F.size(edges)
    mean_y = F.aggregate(edges, F.lit(0.0), lambda a, e: a + e["y1"]) / F.size(edges)
    return F.when(F.abs(m["a"]) > 1e-12, F.struct(
        (first["x1"] + m["x"] / m["a"]).alias("x"), (first["y1"] + m["y"] / m["a"]).alias("y"),
    )).when(F.size(edges) > 0, F.struct(mean_x.alias("x"), mean_y.alias("y")))


def add_shape(
    df: DataFrame, convert=None, geom_type: str = "geom_type", coords: str = "coords_json",
) -> DataFrame:
    """Add ``edges``, ``box``, ``empty``, ``corrupt`` and ``areal`` from coordinate text.

    ``convert`` maps a point array into the metric plane (for instance
    ``lambda ps: crs.utm_forward_points(ps, 43)``); without it coordinates are already metric.

    Every GeoJSON type with coordinates can be read; each line or point of a multi type is a part.  A
    GeometryCollection has no coordinates of its own and counts as empty; a type that GeoJSON does not have,
    or text that is not of the declared type, as corrupt.
    """
    areal = F.coalesce(F.col(geom_type).isin("Polygon", "MultiPolygon"), F.lit(False))
    text = F.trim(F.coalesce(F.col(coords), F.lit("")))
    empty = F.col(geom_type).isNull() | (F.col(geom_type) == "GeometryCollection") | text.isin("", "[]", "null")
    staged = df.withColumn("_rings", F.when(~empty, parse_rings(geom_type, coords)))
    if convert is not None:
        staged = staged.withColumn("_rings", map_points(F.col("_rings"), convert))
    staged = (
        staged.withColumn("areal", areal)
        .withColumn("empty", empty)
        .withColumn("_sound", _sound_rings(F.col("_rings"), F.col(geom_type)))
        .withColumn("corrupt", ~empty & ~F.col("_sound"))
        .withColumn("_rings", F.when(F.col("_sound"), oriented_rings(F.col("_rings"), areal)))
        .withColumn("edges", F.coalesce(
            ring_edges(F.col("_rings"), F.col("areal")), F.array().cast(EDGE_TYPE)))
    )
    return staged.withColumn("box", bounds(F.col("edges"))).drop("_rings", "_sound")


def _sound_rings(rings: Column, geom_type: Column) -> Column:
    """Coordinates could be read, are finite, and every ring or line has enough points."""

    def finite(v):
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    def enough(ring):
        n = F.size(ring)
        polygon = (n >= 4) | ((n == 3) & ~_is_closed(ring))
        return F.when(geom_type.isin("Polygon", "MultiPolygon"), polygon).when(
            geom_type.isin("LineString", "MultiLineString"), n >= 2).otherwise(n == 1)

    def ring_ok(ring):
        points = F.forall(ring, lambda p: finite(p["x"]) & finite(p["y"]))
        return F.when(ring.isNull() | (F.size(ring) == 0), False).otherwise(points & enough(ring))

    ok = F.forall(rings, lambda part: part.isNotNull() & (F.size(part) > 0)
                  & F.forall(part, lambda ring: F.coalesce(ring_ok(ring), F.lit(False))))
    return F.coalesce((F.size(rings) > 0) & ok, F.lit(False))


def metric_43n(points: Column) -> Column:
    """Degrees to UTM zone 43 north, the default metric plane."""
    return crs.utm_forward_points(points, 43)
