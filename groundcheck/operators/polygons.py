"""Measures of pairs of shapes and validity of single shapes, from their edges.

For a pair the area of the common region is a sum over pairs of edges with a common x-range,
``sign_a * sign_b * integral of min(y_a, y_b)``: no clipped polygon is ever built.  Contact and
containment come from the same edge pairs, so one pass gives area, centroid and ``touches``.

Shapes with many edges are cut into x-strips.  A pair then joins only the strips under its common box,
so a country outline against a shed reads a few hundred edges, not all of them.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from groundcheck.operators.gridjoin import CELL, grid_pairs

STRIP_EDGES = 256


def shape_table(df: DataFrame) -> DataFrame:
    """Flatten ``box`` to columns and add the strip layout used by the pair kernel."""
    n = F.greatest(F.ceil(F.size("edges") / float(STRIP_EDGES)), F.lit(1)).cast("int")
    out = df.withColumns({k: F.col("box")[k] for k in ("minx", "miny", "maxx", "maxy")}) \
        if "box" in df.columns else df
    width = F.col("maxx") - F.col("minx")
    strips = F.when(width > 0, n).otherwise(F.lit(1))
    return out.withColumn("strips", strips).withColumn("strip_width", width / strips)


def _strip_of(x: Column, minx: Column, width: Column, strips: Column) -> Column:
    raw = F.when(width > 0, F.floor((x - minx) / width)).otherwise(F.lit(0))
    return F.greatest(F.lit(0), F.least(strips - 1, raw)).cast("int")


_STRIPS = ("minx", "strip_width", "strips")


def edge_strips(shapes: DataFrame, large: bool | None = None) -> DataFrame:
    """``ord, strip, edges`` and the strips' layout: one row for an ordinary shape, one per strip for a large one.

    ``large=False`` skips the branch for shapes above ``STRIP_EDGES`` edges when the caller knows
    there are none; by default one small job finds out.
    """
    if large is None:
        large = not shapes.filter(F.col("strips") > 1).isEmpty()
    small = shapes.filter(F.col("strips") == 1) if large else shapes
    rows = small.select("ord", F.lit(0).alias("strip"), "edges", *_STRIPS[:2], F.lit(1).alias("strips"))
    if not large:
        return rows
    e = F.col("e")
    lo, hi = F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])
    layout = [F.col(c) for c in _STRIPS]
    cut = (
        shapes.filter(F.col("strips") > 1)
        .select("ord", *_STRIPS, F.explode("edges").alias("e"))
        .withColumn("strip", F.explode(F.sequence(_strip_of(lo, *layout), _strip_of(hi, *layout))))
        .groupBy("ord", "strip", *_STRIPS).agg(F.collect_list("e").alias("edges"))
        .select("ord", "strip", "edges", *_STRIPS))
    return rows.unionByName(cut)


_PAIR = ("a_ord", "b_ord")
_LAYOUT = ("minx", "miny", "maxx", "maxy", "strips", "strip_width")


def _side(df: DataFrame, side: str, *cols: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in ("ord", *cols)])


def _common_box(pairs: DataFrame) -> DataFrame:
    return (
        pairs.withColumn("lo", F.greatest("a_minx", "b_minx"))
        .withColumn("hi", F.least("a_maxx", "b_maxx"))
        .withColumn("ox", F.col("lo")).withColumn("oy", F.greatest("a_miny", "b_miny"))
        .withColumn("end", F.col("hi")))


def _with_edges(pairs: DataFrame, left: DataFrame, right: DataFrame, large: bool) -> DataFrame:
    """Pairs with both edge arrays, an origin, and the x-interval ``[lo, hi]`` to look at.

    With large shapes a pair becomes one row per pair of strips under the common box; the intervals
    of these rows tile the common x-range.
    """
    pairs = pairs.select("a_ord", "b_ord")
    if not large:
        cols = (*_LAYOUT[:4], "edges")
        return _common_box(
            pairs.join(_side(left, "a", *cols), "a_ord").join(_side(right, "b", *cols), "b_ord"))
    p = _common_box(pairs.join(_side(left, "a", *_LAYOUT), "a_ord").join(
        _side(right, "b", *_LAYOUT), "b_ord"))
    for side in ("a", "b"):
        minx, width = F.col(f"{side}_minx"), F.col(f"{side}_strip_width")
        strips, strip = F.col(f"{side}_strips"), F.col(f"{side}_strip")
        p = p.withColumn(f"{side}_strip", F.explode(F.sequence(
            _strip_of(F.col("lo"), minx, width, strips),
            _strip_of(F.col("hi"), minx, width, strips))))
        p = p.withColumns({
            "lo": F.when(strip == 0, F.col("lo")).otherwise(F.greatest("lo", minx + strip * width)),
            "hi": F.when(strip == strips - 1, F.col("hi")).otherwise(
                F.least("hi", minx + (strip + 1) * width))}).filter(F.col("lo") <= F.col("hi"))
    p = p.join(_side(edge_strips(left, True), "a", "strip", "edges"), ["a_ord", "a_strip"])
    return p.join(_side(edge_strips(right, True), "b", "strip", "edges"), ["b_ord", "b_strip"])


def _turn(a: str, b: str, c: str) -> str:
    """Sign of the turn a-b-c, for points named ``<name>x, <name>y``."""
    return f"signum(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"


def _solid(expr: str) -> str:
    """A value known not to be null: keeps null checks out of the generated code downstream."""
    return f"coalesce({expr}, 0D)"


def _divide(a: str, b: str) -> str:
    return _solid(f"try_divide({a}, {b})")


# Edge e runs from p to q, edge g from u to v, both relative to the pair's origin.  The work per edge
# pair is staged in small projections: the generated method must stay small enough to be compiled.
_EDGE_PAIR = (
    *[f"{_solid(f'{s}.{c}{i} - o{c}')} as {n}{c}"
      for s, i, n in (("e", 1, "p"), ("e", 2, "q"), ("g", 1, "u"), ("g", 2, "v")) for c in "xy"],
    "coalesce(e.areal and g.areal, false) as solid",
    "coalesce(e.seq = 0 and e.ring = 0 and g.areal, false) as p_first",
    "coalesce(g.seq = 0 and g.ring = 0 and e.areal, false) as u_first")
_GEOMETRY = (
    f"{_turn('p', 'q', 'u')} as d1", f"{_turn('p', 'q', 'v')} as d2",
    f"{_turn('u', 'v', 'p')} as d3", f"{_turn('u', 'v', 'q')} as d4",
    "greatest(least(px, qx), least(ux, vx)) as x0", "least(greatest(px, qx), greatest(ux, vx)) as x1",
    "greatest(least(py, qy), least(uy, vy)) as y0", "least(greatest(py, qy), greatest(uy, vy)) as y1",
    f"{_divide('qy - py', 'qx - px')} as em", f"{_divide('vy - uy', 'vx - ux')} as gm")
_MEET = "x0 <= x1 and y0 <= y1 and d1 * d2 <= 0 and d3 * d4 <= 0"
# the first vertex of a ring counts the edges below it with their sign: 1 inside, 0 outside
_BELOW_P = """if(p_first and lo <= px and (px < hi or hi = end) and least(ux, vx) <= px
  and px < greatest(ux, vx) and uy + gm * (px - ux) < py, if(vx < ux, -1D, 1D), 0D)"""
_BELOW_U = """if(u_first and lo <= ux and (ux < hi or hi = end) and least(px, qx) <= ux
  and ux < greatest(px, qx) and py + em * (ux - px) < uy, if(qx < px, -1D, 1D), 0D)"""


# The edges of a shape as two plain arrays, field after field: about half as many bytes in a shuffle as an array of structs.
_COORDINATES, _MARKS = ("x1", "x2", "y1", "y2"), ("part", "ring", "seq", "n", "areal")


#: The tight box of a packed shape.  Lambdas keep the generated code small, and a value known not to be null keeps null
#: checks, each with all of the packing in it, out of the scan.
_PACKED_BOX = {f"{end}{c}": f"coalesce(array_{end}(filter(xy, (v, i) -> 2 * i {test} size(xy))), 0D)"
               for end in ("min", "max") for c, test in (("x", "<"), ("y", ">="))}


def packed(shapes: DataFrame) -> DataFrame:
    """Replace ``edges`` by ``xy`` (the coordinates of all edges) and ``marks`` (their other fields)."""
    marks = [f"cast(edges.{c} as array<int>)" for c in _MARKS]
    return shapes.filter("size(edges) > 0").withColumns({
        "xy": F.expr(f"concat({', '.join(f'edges.{c}' for c in _COORDINATES)})"),
        "marks": F.expr(f"concat({', '.join(marks)})")}).drop("edges")


def unpacked(prefix: str = "") -> str:
    """The edges that :func:`packed` took apart."""
    n = f"shiftright(size({prefix}xy), 2)"
    at = {c: f"get({prefix}marks, {j} * {n} + i)" for j, c in enumerate(_MARKS)}
    at |= {c: f"get({prefix}xy, {j} * {n} + i)" for j, c in enumerate(_COORDINATES)}
    at["areal"] += " = 1"
    fields = ", ".join(f"{c!r}, {at[c]}" for c in (*_MARKS[:4], "x1", "y1", "x2", "y2", "areal"))
    # the optimizer may take apart a shape without edges before it is filtered out
    numbers = f"if({n} > 0, sequence(0, {n} - 1), cast(array() as array<int>))"
    return f"transform({numbers}, i -> named_struct({fields}))"


def _decoded(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows with ``a_edges, b_edges``: packed ones are taken apart once a pair, before edges are paired."""
    if "a_edges" in rows.columns:
        return rows
    return rows.selectExpr(*keep, f"{unpacked('a_')} as a_edges", f"{unpacked('b_')} as b_edges")


def _edge_pairs(rows: DataFrame, by: tuple[str, ...] = _PAIR) -> DataFrame:
    """One row per pair of edges with a common x-range, relative to the pair's origin; ``by`` names a pair."""
    keep = [*by, "lo", "hi", "end", "ox", "oy"]
    return (
        _decoded(rows, keep)
        .selectExpr(*keep, "b_edges", "explode(a_edges) as e")
        .filter("greatest(e.x1, e.x2) >= lo and least(e.x1, e.x2) <= hi")
        .selectExpr(*keep, "e", "explode(b_edges) as g")
        .filter("greatest(g.x1, g.x2) >= greatest(lo, least(e.x1, e.x2)) and "
                "least(g.x1, g.x2) <= least(hi, greatest(e.x1, e.x2))")
        .selectExpr(
            *by, f"{_solid('ox')} as ox", f"{_solid('oy')} as oy",
            *[f"{_solid(f'{c} - ox')} as {c}" for c in ("lo", "hi", "end")], *_EDGE_PAIR)
        .selectExpr("*", *_GEOMETRY))


def _any_large(left: DataFrame, right: DataFrame) -> bool:
    return not left.select("strips").unionByName(right.select("strips")).filter(
        F.col("strips") > 1).isEmpty()


# the integration interval, both lines at its ends, and the sign of the term (0 without common area)
_SPAN = ("greatest(lo, x0) as l", "least(hi, x1) as r")
_HEIGHTS = (
    "if(solid and l < r, if((qx < px) = (vx < ux), 1D, -1D), 0D) as s",
    "py + em * (l - px) as el", "py + em * (r - px) as er",
    "uy + gm * (l - ux) as gl", "uy + gm * (r - ux) as gr")
# min of two lines is linear except at a crossing, so the common part splits there
_CROSSING = (
    "least(el, gl) as ml", "least(er, gr) as mr",
    "if((el - gl) * (er - gr) < 0, " + _divide(
        "(r - l) * abs(el - gl)", "abs(el - gl) + abs(er - gr)") + ", r - l) as w")
_SPLIT = ("if(w < r - l, el + em * w, mr) as mt",)


def pair_measures(
    pairs: DataFrame, left: DataFrame, right: DataFrame, large: bool | None = None,
) -> DataFrame:
    """``a_ord, b_ord, area, meets`` for each pair; ``meets`` when the closed shapes share a point.

    ``left``/``right`` come from :func:`shape_table`.
    """
    large = _any_large(left, right) if large is None else large
    return _measures(_with_edges(pairs, left, right, large), _PAIR).drop("solid")


def _measures(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    terms = (
        _edge_pairs(rows, by)
        .selectExpr(
            *by, "px", "py", "qx", "ux", "uy", "vx", "em", "gm", "lo", "hi", "solid",
            "x0", "x1", f"({_MEET}) as meet", f"{_BELOW_P} as in_b", f"{_BELOW_U} as in_a")
        .selectExpr("*", *_SPAN)
        .selectExpr(*by, "meet", "in_b", "in_a", "solid", "l", "r", "em", *_HEIGHTS)
        .selectExpr("*", *_CROSSING).selectExpr("*", *_SPLIT)
        .selectExpr(*by, "meet", "in_b", "in_a", "solid",
                    "s * (w * (ml + mt) + (r - l - w) * (mt + mr)) as area2"))
    sums = terms.groupBy(*by).agg(
        F.sum("area2").alias("area2"), F.max("meet").alias("meet"),
        F.sum("in_b").alias("in_b"), F.sum("in_a").alias("in_a"), F.max("solid").alias("solid"))
    return sums.selectExpr(
        *by, "area2", "solid", "meet or abs(in_b) > 0.5 or abs(in_a) > 0.5 as meets",
    ).selectExpr(*by, "if(meets, greatest(area2 / 2, 0D), 0D) as area", "meets", "solid")


def repeats(*layers: DataFrame) -> bool:
    """Whether an ``ord`` comes more than once in one of the layers."""
    return any(not layer.groupBy("ord").count().filter("count > 1").isEmpty() for layer in layers)


def measured_pairs(
    left: DataFrame, right: DataFrame | None = None, keep_left: tuple[str, ...] = (),
    keep_right: tuple[str, ...] = (), large: bool | None = None, repeated: bool | None = None,
) -> DataFrame:
    """Pairs of shapes whose boxes meet, with the measures of :func:`pair_measures` and the kept columns, ``a_`` and ``b_``.

    ``solid`` tells that both shapes have an area; as a measure it can be filtered without changing what is dealt.
    Without ``right`` the layer is paired with itself, smaller ``ord`` first.  Ordinary shapes take their edges
    and kept columns to the cells where they meet, so no pair is dealt again.  Where there are large
    shapes, whose edges must not go to every cell, pairs are found first and then joined with strips; and likewise
    where an ``ord`` is ``repeated`` (by default one small job finds out), as only a join by it tells what belongs together.
    """
    other = left if right is None else right
    large = _any_large(left, other) if large is None else large
    if large or (repeats(*([left] if right is None else [left, right])) if repeated is None else repeated):
        def kept(df: DataFrame, side: str, keep: tuple[str, ...]) -> DataFrame:
            return df.select(*[F.col(c).alias(f"{side}_{c}") for c in ("ord", *keep)])

        return _measures(_with_edges(grid_pairs(left, right), left, other, large), _PAIR).join(
            kept(left, "a", keep_left), "a_ord").join(kept(other, "b", keep_right), "b_ord")
    pairs = grid_pairs(
        packed(left), None if right is None else packed(right), ("xy", "marks", *keep_left),
        ("xy", "marks", *(keep_left if right is None else keep_right)), _PACKED_BOX, True)
    keep = (*[f"a_{c}" for c in keep_left], *[f"b_{c}" for c in (keep_left if right is None else keep_right)])
    by = (*(c for c in CELL if c in pairs.columns), *_PAIR, *keep)
    return _measures(_common_box(pairs), by).select(*_PAIR, "area", "meets", "solid", *keep)


def pair_centroids(
    pairs: DataFrame, left: DataFrame, right: DataFrame, large: bool | None = None,
) -> DataFrame:
    """``a_ord, b_ord, cx, cy``: centre of the common region of pairs that meet.

    Without common area it is the centre of the contact line, or the mean contact point.
    """
    large = _any_large(left, right) if large is None else large
    terms = (
        _edge_pairs(_with_edges(pairs, left, right, large))
        .selectExpr("*", f"({_MEET}) as meet", "d1 = 0 and d2 = 0 as along", *_SPAN,
                    _divide("(ux - px) * (vy - uy) - (uy - py) * (vx - ux)",
                            "(qx - px) * (vy - uy) - (qy - py) * (vx - ux)") + " as at")
        .selectExpr(
            "a_ord", "b_ord", "ox", "oy", "l", "r", "em", *_HEIGHTS,
            "if(meet, 1D, 0D) as n", "if(meet and along, x1 - x0 + y1 - y0, 0D) as len",
            "if(meet, if(along, (x0 + x1) / 2, px + at * (qx - px)), 0D) as tx",
            "if(meet, if(along, (y0 + y1) / 2, py + at * (qy - py)), 0D) as ty")
        .selectExpr("*", *_CROSSING).selectExpr("*", *_SPLIT).selectExpr("*", "l + w as t")
        .selectExpr(
            "a_ord", "b_ord", "ox", "oy", "n", "len", "tx", "ty",
            "s * (w * (ml + mt) + (r - t) * (mt + mr)) / 2 as area",
            """s * (w * (l * (2 * ml + mt) + t * (ml + 2 * mt))
              + (r - t) * (t * (2 * mt + mr) + r * (mt + 2 * mr))) / 6 as mx""",
            """s * (w * (ml * ml + ml * mt + mt * mt)
              + (r - t) * (mt * mt + mt * mr + mr * mr)) / 6 as my"""))
    sums = terms.groupBy("a_ord", "b_ord").agg(*[F.expr(e) for e in (
        "min(ox) as ox", "min(oy) as oy", "sum(area) as area", "sum(mx) as mx", "sum(my) as my",
        "sum(n) as n", "sum(len) as len", "sum(len * tx) as lx", "sum(len * ty) as ly",
        "sum(tx) as tx", "sum(ty) as ty")])

    def centre(origin: str, moment: str, line: str, point: str) -> str:
        return (f"{origin} + case when area > 1e-9 * (1 + abs(ox)) then {moment} / area "
                f"when len > 0 then {line} / len when n > 0 then {point} / n end")

    return sums.selectExpr(
        "a_ord", "b_ord", f"{centre('ox', 'mx', 'lx', 'tx')} as cx",
        f"{centre('oy', 'my', 'ly', 'ty')} as cy")


def _foot(x: str, y: str, a: str, b: str) -> str:
    """Where the point projects on segment a-b: 0 at a, 1 at b."""
    return "greatest(0D, least(1D, " + _divide(
        f"({x} - {a}x) * ({b}x - {a}x) + ({y} - {a}y) * ({b}y - {a}y)",
        f"({b}x - {a}x) * ({b}x - {a}x) + ({b}y - {a}y) * ({b}y - {a}y)") + "))"


def _gap(x: str, y: str, a: str, b: str, foot: str) -> str:
    return f"hypot({x} - {a}x - {foot} * ({b}x - {a}x), {y} - {a}y - {foot} * ({b}y - {a}y))"


def pair_distances(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``a_ord, b_ord, distance`` for pairs of shapes; 0 when they share a point."""
    cols = (*_LAYOUT[:2], "xy", "marks")
    keep = ["a_ord", "b_ord", "ox", "oy"]
    both = pairs.select("a_ord", "b_ord").join(_side(packed(left), "a", *cols), "a_ord").join(
        _side(packed(right), "b", *cols[2:]), "b_ord").withColumnsRenamed({"a_minx": "ox", "a_miny": "oy"})
    edges = (
        _decoded(both, keep)
        .selectExpr(*keep, "b_edges", "explode(a_edges) as e")
        .selectExpr(*keep, "e", "explode(b_edges) as g")
        .selectExpr("a_ord", "b_ord", "-1e300D as lo", "1e300D as hi", "1e300D as end", *_EDGE_PAIR)
        .selectExpr("*", *_GEOMETRY)
        .selectExpr(
            "a_ord", "b_ord", *[f"{p}{c}" for p in "pquv" for c in "xy"],
            f"({_MEET}) as meet", f"{_BELOW_P} as in_b", f"{_BELOW_U} as in_a",
            f"{_foot('px', 'py', 'u', 'v')} as fp", f"{_foot('qx', 'qy', 'u', 'v')} as fq",
            f"{_foot('ux', 'uy', 'p', 'q')} as fu", f"{_foot('vx', 'vy', 'p', 'q')} as fv")
        .selectExpr(
            "a_ord", "b_ord", "in_b", "in_a", "meet",
            f"least({_gap('px', 'py', 'u', 'v', 'fp')}, {_gap('qx', 'qy', 'u', 'v', 'fq')}) as g1",
            f"least({_gap('ux', 'uy', 'p', 'q', 'fu')}, {_gap('vx', 'vy', 'p', 'q', 'fv')}) as g2")
        .selectExpr("a_ord", "b_ord", "in_b", "in_a", "if(meet, 0D, least(g1, g2)) as gap"))
    return edges.groupBy("a_ord", "b_ord").agg(F.expr(
        "if(abs(sum(in_b)) > 0.5 or abs(sum(in_a)) > 0.5, 0D, min(gap)) as distance"))


def _own_pairs(strips: DataFrame) -> DataFrame:
    """One row per ordered pair of edges of the same shape and an x-strip that both reach.

    ``home`` marks the strip that holds the first vertex of the first edge; every edge below it is in there.
    """
    home = _strip_of(F.col("e")["x1"], *(F.col(c) for c in _STRIPS)) == F.col("strip")
    return (
        strips.selectExpr("ord", "strip", *_STRIPS, "edges", "explode(edges) as e")
        .select("ord", "edges", "e", home.alias("home"))
        .selectExpr("ord", "home", "e", "explode(edges) as g")
        .selectExpr(
            "ord", "home", "e.part as ep", "e.ring as er", "e.seq as ei", "e.n as n",
            "g.part as gp", "g.ring as gr", "g.seq as gi",
            *[f"{_solid(f'{s}.{c}{i}')} as {n}{c}"
              for s, i, n in (("e", 1, "p"), ("e", 2, "q"), ("g", 1, "u"), ("g", 2, "v"))
              for c in "xy"])
        .selectExpr("*", *_GEOMETRY))


def _cut_apart(touches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of a shape for each part whose rings and the points where they touch, as a graph, hold a cycle.

    Rows of a part come one after another; a part may begin in one batch and end in another.
    """
    up: dict = {}

    def top(node):
        while up.setdefault(node, node) != node:
            up[node] = up[up[node]]
            node = up[node]
        return node

    at, cut = None, False
    for batch in touches:
        found = []
        for shape, part, ring, x, y in zip(*(batch.column(c).to_pylist() for c in ("ord", "part", "ring", "tx", "ty"))):
            if at != (shape, part):
                at, cut = (shape, part), False
                up.clear()
            if not cut:
                a, b = top(ring), top((x, y))
                up[a] = b
                if cut := a == b:
                    found.append(shape)
        yield pa.RecordBatch.from_arrays([pa.array(found, batch.schema.field("ord").type)], ["ord"])


def disconnected(shapes: DataFrame, large: bool | None = None) -> DataFrame:
    """``ord`` of areal shapes whose interior is cut apart by rings that touch each other.

    Rings that only touch leave the interior in one piece as long as rings and touching points, taken as
    a graph, have no cycle: a hole may hang on its shell or on another hole at one point, and many rings
    may meet in one point.  Only shapes with holes are looked at, and a task holds the touching points
    of one part of one shape at a time.  Rings are taken to be sound otherwise (see :func:`validity`).
    """
    holed = shapes.filter(F.exists("edges", lambda e: e["areal"] & (e["ring"] > 0)))
    # the end of one edge that lies on the other; edges that go on in one line meet where their boxes do
    at = "case when d1 = 0 and d2 = 0 then {c}0 when d1 = 0 then u{c} when d2 = 0 then v{c} when d3 = 0 then p{c} when d4 = 0 then q{c} end"
    touches = _own_pairs(edge_strips(holed, large)).filter(f"ep = gp and er < gr and {_MEET}").selectExpr(
        "ord", "ep as part", "explode(array(er, gr)) as ring", *[f"{at.format(c=c)} as t{c}" for c in "xy"]
    ).filter("tx is not null").repartition("ord", "part").distinct()
    kind = shapes.schema["ord"].dataType.simpleString()
    # parts have few touches and are many: a call per batch, not per part
    return touches.sortWithinPartitions("ord", "part").mapInArrow(_cut_apart, f"ord {kind}").distinct()


def validity(shapes: DataFrame, large: bool | None = None) -> DataFrame:
    """``ord, reason`` for areal shapes whose rings break the polygon rules (valid ones are absent).

    Rings may not cross, run along each other or touch themselves; holes must lie in their outer ring
    and not in one another, parts may not lie in one another, and touching rings may not cut the interior
    apart (:func:`disconnected`).  Edges are compared inside one x-strip only.
    """
    areal = shapes.filter(F.exists("edges", lambda e: e["areal"]))
    if large is None:
        large = not areal.filter(F.col("strips") > 1).isEmpty()
    pairs = (
        _own_pairs(edge_strips(areal, large))
        .selectExpr(
            "ord", "home", "n", "ep", "er", "gp", f"({_MEET}) as meet",
            "struct(ep, er, ei) < struct(gp, gr, gi) as ahead", "ep = gp and er = gr as same_ring",
            "gi - ei = 1 or gi - ei = n - 1 as next",
            "d1 * d2 < 0 and d3 * d4 < 0 as proper",
            "d1 = 0 and d2 = 0 and x0 <= x1 and y0 <= y1 and (x0 < x1 or y0 < y1) as along",
            # first vertex of a hole against its outer ring or another hole, of a part against another part
            """case when ei <> 0 then null when ep <> gp and er = 0 then 'part'
              when ep = gp and er > 0 and gr = 0 then 'hole'
              when ep = gp and er > 0 and gr > 0 and er <> gr then 'inner' end as test""",
            "if(ep = gp, gr, -1) as gr",
            """if(least(ux, vx) <= px and px < greatest(ux, vx) and uy + gm * (px - ux) < py, if(vx < ux, -1D, 1D), 0D)
              as below""",
            """if(ei = 0, x0 <= x1 and y0 <= y1 and d3 = 0 and px between least(ux, vx) and
              greatest(ux, vx) and py between least(uy, vy) and greatest(uy, vy), false) as on_edge"""))
    crossings = pairs.groupBy("ord").agg(*[F.expr(e) for e in (
        "max(n < 3) as short", "max(ahead and (proper or along)) as crossing",
        "max(ahead and same_ring and not next and meet) as self_touch")])
    # the count below a vertex is complete in its own strip, and only there
    rings = pairs.filter("test is not null and home").groupBy("ord", "ep", "er", "gp", "gr", "test").agg(
        F.expr("abs(sum(below)) as wind"), F.expr("max(on_edge) as on_edge")).groupBy("ord").agg(
        F.expr("max(test = 'hole' and wind < 0.5 and not on_edge) as hole_out"),
        F.expr("max(test = 'inner' and wind > 0.5 and not on_edge) as hole_in"),
        F.expr("max(test = 'part' and wind > 0.5 and not on_edge) as nested"))
    reason = F.expr("""case when short then 'Too few points in geometry component'
      when crossing then 'Self-intersection' when self_touch then 'Ring Self-intersection'
      when hole_out then 'Hole lies outside shell' when hole_in then 'Holes are nested'
      when nested then 'Nested shells' when apart then 'Interior is disconnected' end""")
    apart = disconnected(areal, large).withColumn("apart", F.lit(True))
    return crossings.join(rings, "ord", "left").join(apart, "ord", "left").select(
        "ord", reason.alias("reason")).filter(F.col("reason").isNotNull())
