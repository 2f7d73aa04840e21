"""Grid-partitioned bounding-box join.

Cells come in sizes 4^k.  A box lives at the level that suits its own size, one to four times the smallest that
does, so it mostly lies in one or two cells, never in more than 64 however long it is, and a box of any size costs the same.  Two boxes meet at the coarser of their
two levels: the coarser one is looked up at home, the finer one as a probe.  Where that makes fewer rows, all left boxes
stay at home instead and the right ones come to their levels: a few wide boxes then go to many small ones.  A pair is
kept only in the cell holding the lower-left corner of the common box, so no ``distinct`` is needed.

Cells that would produce too many comparisons in one task are split in blocks on both sides; every
block pair is still compared, so nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundcheck.lineage import cut_lineage

_LOG4 = 1.3862943611198906
_FINEST = 4.0**-6
_LEVELS = range(-6, 25)
BLOCK_ROWS = 16384
#: Boxes per counter when cells are counted by hash.
COUNTED = 1024

_BOX = ("minx", "miny", "maxx", "maxy")
#: Columns by which boxes may be dealt: a cell and, where some are too big for one task, a block of each side.
CELL = ("role", "level", "cx", "cy", "ba", "bb")


def _home_level(df: DataFrame) -> DataFrame:
    return df.withColumn("home", F.expr(f"""int(greatest({_LEVELS[0]}, least({_LEVELS[-1]}, ceil(log(
      greatest(least(maxx - minx, maxy - miny), greatest(maxx - minx, maxy - miny) / 30, {_FINEST}D))
      / {_LOG4}D) + 1)))"""))


def _stats(df: DataFrame) -> tuple[int, list[int]]:
    """Row count and the levels in use: one row, at most 31 small integers."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.collect_set("home").alias("levels")).first()
    return row["n"], sorted(row["levels"])


def _covered(level: str) -> str:
    """Cells of a level that a box covers."""
    spans = [f"(floor(max{c} / pow(4D, {level})) - floor(min{c} / pow(4D, {level})) + 1)" for c in "xy"]
    return " * ".join(spans)


def _left_stays(a: DataFrame, b: DataFrame, levels_a: list[int], levels_b: list[int]) -> bool:
    """Whether fewer rows are dealt when left boxes visit their own level only and right ones all levels of the left."""
    def total(df: DataFrame, levels: list[int], test: str) -> float:
        terms = [f"if({k} {test} home, {_covered(str(k))}, 0)" for k in levels]
        return df.selectExpr(f"double(sum({' + '.join(terms)})) as n").first()["n"] or 0.0

    if not levels_a or not levels_b or levels_a == levels_b == levels_a[:1]:
        return bool(levels_a and levels_b)
    at_home = f"if(home > {levels_a[0]}, {_covered('home')}, 0)"
    spared = total(a, levels_b, ">") + (b.selectExpr(f"double(sum({at_home})) as n").first()["n"] or 0.0)
    return total(b, levels_a, "<") <= spared


def _visits(df: DataFrame, visits: str) -> DataFrame:
    """One row per (role, level, cell) that a box takes part in."""
    return (
        df.selectExpr("*", f"inline({visits})")
        .selectExpr("*", "pow(4D, level) as size")
        .selectExpr("*", "explode(sequence(floor(minx / size), floor(maxx / size))) as cx")
        .selectExpr("*", "explode(sequence(floor(miny / size), floor(maxy / size))) as cy"))


def _split_hot(a: DataFrame, b: DataFrame, keys: list[str], counters: int) -> tuple[DataFrame, DataFrame, bool]:
    """Add block numbers ``ba``/``bb`` (0 but in cells too big for one task), and whether there are such cells at all.

    Cells are many and nearly all small, so they are counted by hash first; only cells that share a counter that is
    too big are counted one by one.
    """
    sides = a.select(*keys, F.lit(1).alias("ia"), F.lit(0).alias("ib")).unionByName(
        b.select(*keys, F.lit(0).alias("ia"), F.lit(1).alias("ib"))).withColumn(
        "counter", F.pmod(F.xxhash64(*keys), F.lit(counters)))

    def heavy(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.sum("ia").alias("na"), F.sum("ib").alias("nb")).filter(
            F.col("na").cast("double") * F.col("nb") > float(BLOCK_ROWS) ** 2)

    suspect = cut_lineage(heavy(sides, "counter").select("counter"))
    hot = heavy(sides.join(suspect, "counter", "left_semi"), *keys).select(
        *keys, F.ceil(F.col("na") / BLOCK_ROWS).cast("int").alias("blocks_a"),
        F.ceil(F.col("nb") / BLOCK_ROWS).cast("int").alias("blocks_b"))
    if suspect.isEmpty() or hot.isEmpty():
        return a, b, False

    hot = cut_lineage(hot)

    def blocks(df: DataFrame, own: str, own_count: str, other: str, other_count: str) -> DataFrame:
        mine = F.coalesce(F.col(own_count), F.lit(1))
        theirs = F.coalesce(F.col(other_count), F.lit(1))
        return (
            df.join(hot, keys, "left")
            .withColumn(own, F.pmod(F.xxhash64("ord"), mine).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), theirs - 1)))
            .drop("blocks_a", "blocks_b"))

    return (blocks(a, "ba", "blocks_a", "bb", "blocks_b"),
            blocks(b, "bb", "blocks_b", "ba", "blocks_a"), True)


def grid_pairs(
    left: DataFrame, right: DataFrame | None = None, keep_left: tuple[str, ...] = (),
    keep_right: tuple[str, ...] = (), box: dict[str, str] | None = None, cells: bool = False,
) -> DataFrame:
    """Pairs of boxes that share at least one point: columns ``a_ord``, ``b_ord`` and the kept ones.

    Inputs need a unique ``ord`` and ``minx,miny,maxx,maxy`` (rows with null boxes pair with nothing).
    Without ``right`` the layer is paired with itself and each pair comes once, smaller ``ord`` first.
    ``keep_left``/``keep_right`` columns come back prefixed ``a_``/``b_``.  ``box`` says how ``minx,miny,maxx,maxy`` follow from
    columns kept on both sides: they are worked out after the rows are dealt, and come back too.  With ``cells``
    the columns by which pairs were dealt (those of :data:`CELL` in use) come back, so that what is grouped by them stays where it is.
    """
    self_join = right is None

    def boxes(df: DataFrame, keep) -> DataFrame:
        cols = ["ord", *_BOX, *[c for c in keep if c not in ("ord", *_BOX)]]
        return _home_level(df.select(*cols).filter(F.col("minx").isNotNull()))

    a = boxes(left, keep_left)
    b = boxes(left if self_join else right, keep_right)
    na, levels_a = _stats(a)
    nb, levels_b = (na, levels_a) if self_join else _stats(b)

    def lookups(levels: list[int], test: str, role: int) -> str:
        listed = ", ".join(str(k) for k in levels) or "int(null)"
        return (f"transform(filter(array({listed}), m -> m {test}), "
                f"m -> named_struct('role', {role}, 'level', m))")

    at_home = "array(named_struct('role', {}, 'level', home))"
    a_visits = at_home.format(0)
    stays = _left_stays(a, b, levels_a, levels_b)
    if stays:
        b_visits = a_visits if levels_a == levels_b == levels_a[:1] else lookups(levels_a, "is not null", 0)
    else:
        a_visits = f"concat({a_visits}, {lookups(levels_b, '> home', 1)})"
        if levels_b and levels_a and levels_a[0] < levels_b[0]:
            a_visits = f"filter({a_visits}, v -> v.level >= {levels_b[0]})"
        b_visits = lookups(levels_a, ">= home", 0)
        if levels_a and levels_b and levels_a[0] < levels_b[-1]:
            b_visits = (f"concat({b_visits}, filter({at_home.format(1)}, "
                        f"v -> v.level > {levels_a[0]}))")
    a, b = _visits(a, a_visits), _visits(b, b_visits)

    # no column that is the same in all rows: the optimizer drops it from some of the steps, which then deal anew
    keys = [c for c in CELL[:4] if c != "role" or not stays]
    if na * nb > BLOCK_ROWS**2:
        a, b, blocked = _split_hot(a, b, keys, (na + nb) // COUNTED + 1)
        keys += CELL[4:] if blocked else ()

    def named(df: DataFrame, side: str, keep: tuple[str, ...]) -> DataFrame:
        cols = dict.fromkeys(("ord", *(() if box else _BOX), *keep))
        if box:
            df = df.selectExpr(*keys, *cols).repartition(*keys).selectExpr(*keys, *cols, *[f"{box[c]} as {c}" for c in _BOX])
            cols |= dict.fromkeys(_BOX)
        return df.selectExpr(*keys, *[f"{c} as {side}_{c}" for c in cols])

    joined = named(a, "a", keep_left).join(named(b, "b", keep_right), keys).filter("""
      a_minx <= b_maxx and b_minx <= a_maxx and a_miny <= b_maxy and b_miny <= a_maxy
      and floor(greatest(a_minx, b_minx) / pow(4D, level)) = cx
      and floor(greatest(a_miny, b_miny) / pow(4D, level)) = cy""")
    if self_join:
        # a bare comparison would add a null check to the scan, which then serves no other join
        joined = joined.filter("coalesce(a_ord < b_ord, false)")
    kept = ["a_ord", "b_ord", *[f"a_{c}" for c in keep_left if c != "ord"],
            *[f"b_{c}" for c in keep_right if c != "ord"]]
    if box:
        kept += [f"{side}_{c}" for side in "ab" for c in _BOX]
    return joined.select(*(keys if cells else ()), *kept)
