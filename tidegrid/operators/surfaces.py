"""Distances, interpolation along lines, seam blends, the multi-resolution fill and polygons of cell tables.

The tables (row, col, z) hold a row for every cell of the grid, with null z in voids. Everything runs along one row or one
column at a time, so no task holds more than a line; only the extent of a blend zone is one aggregated row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegrid.functions.grid import GridSpec
from tidegrid.functions.shared import components, stash
from tidegrid.operators.filters import polygon_edges
from tidegrid.operators.rasters import auto_stack_mask, blend_background, by_side, decimate, fill_idw, interp_nearest, slope
from tidegrid.operators.splines import interp_spline
from tidegrid.operators.triangles import interp_triangles

_CELL = ["row", "col"]
_AXES = (("row", "col"), ("col", "row"))


def _both_ways(line: str, order: str):
    """Windows from either end of a line to the current cell. Two orders, as a frame to the end of a partition is computed
    anew for each of its rows."""
    return [Window.partitionBy(line).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(order), F.desc(order))]


def taxicab(cells: DataFrame, mask: Column, name: str = "distance") -> DataFrame:
    """`cells` with the taxicab distance to the nearest cell where `mask` holds, null where it holds nowhere."""
    out = cells.withColumn("_tx", F.when(mask, F.col("col")))
    west, east = (F.last("_tx", True).over(w) for w in _both_ways("row", "col"))
    out = out.withColumn("_ty", F.least(F.col("col") - west, east - F.col("col")))
    north, south = _both_ways("col", "row")
    up = F.min(F.col("_ty") - F.col("row")).over(north) + F.col("row")
    down = F.min(F.col("_ty") + F.col("row")).over(south) - F.col("row")
    return out.withColumn(name, F.least(up, down).cast("int")).drop("_tx", "_ty")


def _closed(cells: DataFrame, mask: Column, name: str) -> DataFrame:
    """Closing of a mask by one cell, 8-connected; beyond the grid nothing counts."""
    out = cells.withColumn(name, mask.cast("int"))
    for f in (F.max, F.min):
        for line, order in _AXES:
            out = out.withColumn(name, f(name).over(Window.partitionBy(line).orderBy(order).rangeBetween(-1, 1)))
    return out.withColumn(name, F.col(name) == 1)


def _cubic(at: Column, p: list[Column], v: list[Column]) -> Column:
    """The cubic through four knots."""
    terms = []
    for i in range(4):
        term = v[i]
        for j in range(4):
            if i != j:
                term = F.try_divide(term * (at - p[j]), p[i] - p[j])
        terms.append(term)
    return terms[0] + terms[1] + terms[2] + terms[3]


def interp_lines(cells: DataFrame, method: str = "linear", z: str = "z") -> DataFrame:
    """Voids of `z` between cells with data on their row or column; other columns stay.

    linear: between the two nearest cells on a line; cubic: through the two nearest on either side, linear where there is
    but one. The values along row and column are averaged by the inverse of their gaps. Both give back what is linear
    (cubic) along the lines exactly. A void with data on one side only stays one, as outside a hull.
    """
    if method not in ("linear", "cubic"):
        raise ValueError(f"no method {method}")
    out, found = cells.withColumn("_has", F.col(z).isNotNull()), []
    for line, order in _AXES:
        knots = []
        for w, direction in zip(_both_ways(line, order), (F.asc, F.desc), strict=True):
            among = Window.partitionBy(line, "_has").orderBy(direction(order))
            name = f"_{line}{len(knots)}"
            knot = F.struct(F.col(order).alias("p"), F.col(z).alias("v"), F.lag(order).over(among).alias("pp"), F.lag(z).over(among).alias("pv"))
            out = out.withColumn(name, knot).withColumn(name, F.last(F.when(F.col("_has"), F.col(name)), True).over(w))
            knots.append(F.col(name))
        a, b = knots
        gap = b["p"] - a["p"]
        value = a["v"] + F.try_divide((b["v"] - a["v"]) * (F.col(order) - a["p"]), gap)
        if method == "cubic":
            value = F.coalesce(_cubic(F.col(order), [a["pp"], a["p"], b["p"], b["pp"]], [a["pv"], a["v"], b["v"], b["pv"]]), value)
        found.append((value, gap))
    (h, hg), (v, vg) = found
    both = F.try_divide(h * vg + v * hg, hg + vg)
    return out.withColumn(z, F.coalesce(z, both, h, v)).drop("_has", *[f"_{line}{i}" for line, _ in _AXES for i in (0, 1)])


def interp(cells: DataFrame, method: str = "linear", reach: int = 4) -> DataFrame:
    """(row, col, z) with voids filled: linear or cubic along lines, nearest or inverse distances (idw) within `reach`, and over the triangles of the data
    delaunay (linear) or clough_tocher (cubic); spline: a spline in tension, which leaves no void."""
    if method == "spline":
        return interp_spline(cells)
    if method in ("delaunay", "clough_tocher"):
        return interp_triangles(cells, "linear" if method == "delaunay" else "cubic")
    if method == "nearest":
        return interp_nearest(cells, reach)
    return fill_idw(cells, reach) if method == "idw" else interp_lines(cells, method).select(*_CELL, "z")


def _normed(cells: DataFrame, zone: str, value: str) -> DataFrame:
    """`cells` with `_t`: `value` scaled to 0..1 over the zone."""
    ends = cells.filter(zone).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))  # one row
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return cells.crossJoin(F.broadcast(ends)).withColumn("_t", scaled).drop("_lo", "_hi")


def _picked(cells: DataFrame, zone: str, scale: float, slope_scale: float, seed: int) -> DataFrame:
    """`cells` with `_pick`: a share `scale` of them by a hash of their place, only where the slope, as a part of the zone's
    greatest, reaches `slope_scale`."""
    if scale <= 0:
        return cells.withColumn("_pick", F.lit(False))
    grain = 1 << 20
    pick = F.pmod(F.xxhash64("row", "col", F.lit(seed)), F.lit(grain)) < int(scale * grain)
    if slope_scale > 0:
        cells = slope(cells)
        top = cells.filter(zone).agg(F.max("slope").alias("_top"))  # one row
        cells = cells.crossJoin(F.broadcast(top))
        pick = pick & (F.coalesce(F.try_divide("slope", "_top"), F.lit(1.0)) >= slope_scale)
    return cells.withColumn("_pick", pick)


def ms_blend(
    cells: DataFrame, weight_threshold: float = 1.0, blend_dist: int = 5, slope_scale: float = 0.5, random_scale: float = 0.025,
    method: str = "linear", seed: int = 0,
) -> DataFrame:
    """Blend well-weighted cells of a stack (row, col, z, weights) into the others.

    The zone is what lies within `blend_dist` of the closed foreground and has data. It is interpolated from all other cells
    and a share of its own (see `_picked`), and goes over into the original by the distance from the foreground. Where
    nothing can be interpolated the original stays.
    """
    data = F.col("z").isNotNull()
    grid = cells.select(*_CELL, "z", (data & (F.coalesce("weights", F.lit(0.0)) >= weight_threshold)).alias("_fg"))
    grid = taxicab(_closed(grid, F.col("_fg"), "_core"), F.col("_core"), "_far")
    grid = grid.withColumn("_zone", F.coalesce(data & ~F.col("_core") & (F.col("_far") <= blend_dist), F.lit(False)))
    grid = _picked(taxicab(grid, F.col("_fg"), "_d"), "_zone", random_scale, slope_scale, seed)
    grid = grid.withColumn("_i", F.when(~F.col("_zone") | F.col("_pick"), F.col("z")))
    grid = interp_lines(_normed(grid, "_zone", "_d"), method, "_i")
    mixed = (1 - F.col("_t")) * F.col("_i") + F.col("_t") * F.col("z")
    return grid.select(*_CELL, F.when(F.col("_zone"), F.coalesce(mixed, "z")).otherwise(F.col("z")).alias("z"))


def raster_blend(
    cells: DataFrame, aux: DataFrame, blend_dist: int = 5, core_dist: int = 1, slope_scale: float = 0.5, random_scale: float = 0.025,
    method: str = "linear", seed: int = 0,
) -> DataFrame:
    """Blend a second surface into `cells`, whose voids stay.

    The zone is the closed extent of `aux` grown by `blend_dist`, where `cells` has data. Its surface is interpolated from
    `aux`, from `cells` outside, and from a share of `cells` beyond `core_dist` of the extent; it replaces `cells` by
    the depth within the zone's outline, from 0 at the least to 1 at the greatest.
    """
    both = cells.select(*_CELL, "z").join(aux.select(*_CELL, F.col("z").alias("_a")), _CELL, "left")
    grid = taxicab(_closed(both, F.col("_a").isNotNull(), "_core"), F.col("_core"), "_far")
    grid = grid.withColumn("_grown", F.coalesce(F.col("_far") <= blend_dist, F.lit(False)))
    grid = grid.withColumn("_zone", F.col("_grown") & F.col("z").isNotNull())
    grid = _picked(taxicab(grid, ~F.col("_grown"), "_d"), "_zone", random_scale, slope_scale, seed)
    own = ~F.col("_grown") | (F.col("_pick") & (F.col("_far") > core_dist))
    grid = grid.withColumn("_i", F.coalesce("_a", F.when(own, F.col("z"))))
    grid = interp_lines(_normed(grid, "_zone", "_d"), method, "_i")
    mixed = F.col("z") + F.coalesce(F.col("_i") - F.col("z"), F.lit(0.0)) * F.col("_t")
    return grid.select(*_CELL, F.when(F.col("_zone"), mixed).otherwise(F.col("z")).alias("z"))


def cudem_levels(steps: int = 2, weights=(1.0, 0.5), factors=(1, 3)) -> dict[str, tuple]:
    """Factors and weights of `ms_cudem` from lists that begin at the finest level and go on by themselves: each further weight is half the last, each
    further factor three times it."""
    weights, factors = [*weights][: steps + 1], [*factors][: steps + 1]
    while len(weights) <= steps:
        weights.append(weights[-1] / 2)
    while len(factors) <= steps:
        factors.append(factors[-1] * 3)
    return {"factors": tuple(factors[::-1]), "weights": tuple(weights[::-1])}


def ms_cudem(
    cells: DataFrame, factors=(9, 3, 1), weights=(0.25, 0.5, 1.0), method: str = "idw", reach: int = 4, barrier: list | DataFrame | None = None,
    grid: GridSpec | None = None, background: str = "cell",
) -> DataFrame:
    """Multi-resolution fill of a stack (row, col, z, count, weights): from the coarsest factor to the finest, average the
    stack, patch its voids from the surface before (`background`: cell or cubic, see `blend_background`), and interpolate what has the level's weight by
    `method` (see `interp`). With a `barrier` (see `by_side`) and the
    cells' `grid`, all levels but the finest are interpolated on either side by itself."""
    surface, before = None, None
    if barrier is not None and not isinstance(barrier, DataFrame):
        barrier = polygon_edges(cells.sparkSession, barrier)
    for k, weight in zip(factors, weights, strict=True):
        level = decimate(cells, k, ("z", "count", "weights"))
        if surface is not None:
            level = blend_background(level.withColumn("count", F.ceil("count")), surface, before // k, weight, background)
        level = auto_stack_mask(level, weight)
        if barrier is None or k == factors[-1]:
            level = interp(level, method, reach)
        else:
            coarse = GridSpec(grid.region, grid.xinc * k, grid.yinc * k)
            level = by_side(level, coarse, barrier, lambda c: interp(c, method, reach))
        # a level is read several times by the next
        surface, before = stash(level, "cudem"), k
    return surface


def label_cells(cells: DataFrame, mask: Column) -> DataFrame:
    """(row, col, label, sides) of the cells where `mask` holds: label of their 4-connected patch, and how many of their sides
    are on its outline. Runs along a row are the nodes of the graph, so it is much smaller than the grid."""
    land = cells.filter(mask).select(*_CELL)
    along, across = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    start = F.when(F.coalesce(F.lag("col").over(along) != F.col("col") - 1, F.lit(True)), F.col("col"))
    runs = land.withColumn("_s", start).withColumn("_s", F.last("_s", True).over(along))
    runs = runs.withColumn("run", F.shiftleft(F.col("row").cast("long"), 32) + F.col("_s"))
    near = lambda f, c, w, d: F.coalesce((f(c).over(w) == F.col(c) + d), F.lit(False))
    touch = [near(F.lag, "col", along, -1), near(F.lead, "col", along, 1), near(F.lag, "row", across, -1), near(F.lead, "row", across, 1)]
    runs = runs.withColumn("sides", 4 - sum((t.cast("int") for t in touch[1:]), touch[0].cast("int")))
    runs = stash(runs.withColumn("above", F.when(near(F.lag, "row", across, -1), F.lag("run").over(across))).drop("_s"), "runs")
    joined = components(runs.filter("above IS NOT NULL").select(F.col("run").alias("a"), F.col("above").alias("b")))
    out = runs.join(joined.withColumnRenamed("id", "run"), "run", "left")
    return out.select(*_CELL, F.coalesce("component_id", "run").alias("label"), "sides")


def polygons(cells: DataFrame, mask: Column, grid: GridSpec) -> DataFrame:
    """A row per 4-connected patch: label, cells, sides of its outline, area and bounds (w, e, s, n)."""
    p, r = label_cells(cells, mask), grid.region
    return p.groupBy("label").agg(
        F.count("*").alias("n_cells"), F.sum("sides").alias("n_sides"), (F.count("*") * F.lit(grid.xinc * grid.yinc)).alias("area"),
        (r.w + F.min("col") * grid.xinc).alias("w"), (r.w + (F.max("col") + 1) * grid.xinc).alias("e"),
        (r.n - (F.max("row") + 1) * grid.yinc).alias("s"), (r.n - F.min("row") * grid.yinc).alias("n"),
    )


def coast_patches(lines: DataFrame, grid: GridSpec, off: float = 2.0) -> DataFrame:
    """(row, col, label, land): the cells of a grid that no coast line (x1, y1, x2, y2, with the land on its left) runs through, by 4-connected patch.

    Points `off` cells to either side of the middles of the lines vote in the patch they lie in: it is land where more than half of them are on
    a line's left, and null where there are none.
    """
    u, v = (lambda c: (F.col(c) - grid.region.w) / grid.xinc), (lambda c: (F.lit(grid.region.n) - F.col(c)) / grid.yinc)
    at = lines.select(u("x1").alias("u1"), v("y1").alias("v1"), u("x2").alias("u2"), v("y2").alias("v2"))
    du, dv = F.col("u2") - F.col("u1"), F.col("v2") - F.col("v1")
    # by half cells, so that a line's cells leave no gap for a side to pass through
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(du), F.abs(dv)) * 2))
    walk = at.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint"))))
    along = lambda a, d: F.floor(F.col(a) + d * F.col("i") / F.col("n")).cast("int")
    wall = walk.select(along("v1", dv).alias("row"), along("u1", du).alias("col")).distinct()
    cells = lines.sparkSession.range(grid.rows * grid.cols).select(F.floor(F.col("id") / grid.cols).cast("int").alias("row"), (F.col("id") % grid.cols).cast("int").alias("col"))
    patches = label_cells(cells.join(wall, _CELL, "left_anti"), F.lit(True)).drop("sides")
    length = F.sqrt(du * du + dv * dv)
    side = lambda k: F.struct(
        F.floor((F.col("v1") + F.col("v2")) / 2 - k * off * du / length).cast("int").alias("row"),
        F.floor((F.col("u1") + F.col("u2")) / 2 + k * off * dv / length).cast("int").alias("col"), F.lit(float(k > 0)).alias("left"),
    )
    votes = at.filter(length > 0).select(F.inline(F.array(side(1), side(-1)))).join(patches, _CELL).groupBy("label").agg((F.avg("left") > 0.5).alias("land"))
    return patches.join(votes, "label", "left").select(*_CELL, "label", "land")


def outlines(cells: DataFrame, mask: Column, grid: GridSpec) -> DataFrame:
    """(label, x1, y1, x2, y2): the cell sides on the outline of each patch, with the patch on their left."""
    p = label_cells(cells, mask).filter("sides > 0").select(*_CELL, "label")
    inside = cells.filter(mask).select(*_CELL)
    side = lambda dr, dc, a, b: F.struct(
        (F.col("r0") + dr).alias("row"), (F.col("c0") + dc).alias("col"),
        *[(F.lit(grid.region.w) + (F.col("c0") + c) * grid.xinc).alias(f"x{i}") if w == "x" else (F.lit(grid.region.n) - (F.col("r0") + r) * grid.yinc).alias(f"y{i}")
          for i, (r, c) in ((1, a), (2, b)) for w in "xy"],
    )
    four = F.array(side(-1, 0, (0, 1), (0, 0)), side(0, -1, (0, 0), (1, 0)), side(1, 0, (1, 0), (1, 1)), side(0, 1, (1, 1), (0, 1)))
    each = p.withColumnRenamed("row", "r0").withColumnRenamed("col", "c0").select("label", F.inline(four))
    return each.join(inside, _CELL, "left_anti").select("label", "x1", "y1", "x2", "y2")
