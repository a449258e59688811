"""Grid to grid operators over cell tables (row, col, z); a cell without a row, or with null z, has no data.

Moving windows are separable: one pass along rows and one along columns, each within its own row or column, so no task
holds more than one line of the grid a window.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from tidegrid.functions.grid import GridSpec, Region
from tidegrid.functions.shared import stash
from tidegrid.operators.filters import inside_polygons, polygon_edges, sample, sample_bilinear, sample_cubic

_CELL = ["row", "col"]


def _centred(cells: DataFrame, grid: GridSpec) -> DataFrame:
    """(row, col, x, y, _cell): the cells with their centres and one key for each."""
    return grid.centres(cells.select(*_CELL)).withColumn("_cell", F.shiftleft(F.col("row").cast("long"), 32) + F.col("col"))


def align(cells: DataFrame, grid: GridSpec, other: DataFrame, other_grid: GridSpec, method: str = "bilinear") -> DataFrame:
    """(row, col, z) of `other` at the centres of `cells`; null where it has nothing there. bilinear, cubic (see
    `sample_cubic`), or nearest: of the cell around it."""
    at = _centred(cells, grid)
    if method == "nearest":
        return sample(at, other, other_grid, "z", "z").select(*_CELL, "z")
    if method == "cubic":
        return sample_cubic(at, other, other_grid, "z", "z", _CELL)
    if method != "bilinear":
        raise ValueError(f"no method {method}")
    return at.join(sample_bilinear(at, other, other_grid, "z", "z", "_cell"), "_cell").select(*_CELL, "z")


def by_side(cells: DataFrame, grid: GridSpec, barrier: list | DataFrame, op: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`op` on either side of a barrier by itself: on the cells whose centre lies in one of the polygons, and on the others. `barrier`: polygons, a list
    of rings each, or a table of edges. `op` gets the whole grid with the other side void, and keeps row and col."""
    edges = barrier if isinstance(barrier, DataFrame) else polygon_edges(cells.sparkSession, barrier)
    at = _centred(cells, grid)
    # a written grid is much smaller than its cells: joined by its size on disk, it would be broadcast
    inside = at.hint("merge").join(inside_polygons(at, edges, "_cell"), "_cell").select(*_CELL)
    marked = stash(cells.join(inside.withColumn("_in", F.lit(True)), _CELL, "left").withColumn("_in", F.coalesce("_in", F.lit(False))), "sides")
    parts = []
    for side in (True, False):
        own = marked.filter(F.col("_in") == side).select(*_CELL)
        seen = marked.withColumn("z", F.when(F.col("_in") == side, F.col("z"))).drop("_in")
        parts.append(op(seen).join(own.hint("merge"), _CELL, "left_semi"))
    return parts[0].unionByName(parts[1])


def raster_diff(
    cells: DataFrame, other: DataFrame, mode: str = "filter", threshold: float = 0.0, grid: GridSpec | None = None, other_grid: GridSpec | None = None,
    method: str = "bilinear",
) -> DataFrame:
    """difference: z less the other's; filter: z, null where the difference exceeds the threshold. With both grids the other is aligned first."""
    aligned = grid is not None and other_grid is not None
    if aligned and method == "cubic":
        both = sample_cubic(grid.centres(cells.select(*_CELL, "z")), other, other_grid, "z", "_o", [*_CELL, "z"])
    else:
        other = align(cells, grid, other, other_grid, method) if aligned else other
        both = cells.join(other.select(*_CELL, F.col("z").alias("_o")), _CELL, "left")
    d = F.col("z") - F.col("_o")
    z = d if mode == "difference" else F.when(F.coalesce(F.abs(d) <= threshold, F.lit(True)), F.col("z"))
    return both.select(*_CELL, z.alias("z"))


def raster_cut(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The cells of a window, both ends included."""
    return cells.filter(F.col("row").between(*rows) & F.col("col").between(*cols))


def _filled(cells: DataFrame) -> DataFrame:
    """`cells` with the mean where z is null."""
    mean = cells.agg(F.avg("z").alias("_mean"))  # one row
    return cells.crossJoin(F.broadcast(mean)).withColumn("_z", F.coalesce("z", "_mean")).drop("_mean")


def slope(cells: DataFrame, xinc: float = 1.0, yinc: float = 1.0) -> DataFrame:
    """`cells` with the slope: central differences, one-sided at the edges."""

    def along(order: str, line: str, inc: float):
        w = Window.partitionBy(line).orderBy(order)
        before, after = F.lag("_z").over(w), F.lead("_z").over(w)
        span = (F.when(before.isNull(), 0).otherwise(1) + F.when(after.isNull(), 0).otherwise(1)) * inc
        return F.coalesce(F.try_divide(F.coalesce(after, F.col("_z")) - F.coalesce(before, F.col("_z")), span), F.lit(0.0))

    out = _filled(cells).withColumn("_gx", along("col", "row", xinc)).withColumn("_gy", along("row", "col", yinc))
    return out.withColumn("slope", F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))).drop("_gx", "_gy", "_z")


def slope_filter(cells: DataFrame, low: float | None = None, high: float | None = None, xinc: float = 1.0, yinc: float = 1.0) -> DataFrame:
    """z, null where the slope is under `low` or over `high`."""
    bad = F.lit(False)
    bad = bad | (F.col("slope") < low) if low is not None else bad
    bad = bad | (F.col("slope") > high) if high is not None else bad
    return slope(cells, xinc, yinc).select(*_CELL, F.when(~bad, F.col("z")).alias("z"))


def _mirrored(cells: DataFrame, rows, cols, h: int) -> DataFrame:
    """`cells` and their mirror images up to h cells beyond the edges of a grid of rows x cols (numbers or columns)."""

    def images(name: str, n):
        at = F.col(name)
        own = [at, F.when(at < h, -1 - at), F.when(at >= n - h, 2 * n - 1 - at)]
        return F.explode(F.filter(F.array(*own), lambda x: x.isNotNull()))

    return cells.withColumn("_r", images("row", rows)).withColumn("_c", images("col", cols)).withColumn("row", F.col("_r")).withColumn("col", F.col("_c")).drop("_r", "_c")


def zscore_filter(cells: DataFrame, rows: int | None = None, cols: int | None = None, threshold: float = 3.0, kernel: int = 5) -> DataFrame:
    """z, null where |z - local mean| / local deviation exceeds the threshold; the box window mirrors at the edges. Without `rows` or
    `cols` the grid ends at the last row and column that there are."""
    h = kernel // 2
    ends = cells.agg((F.max("row") + 1).alias("_nr"), (F.max("col") + 1).alias("_nc"))  # one row
    grid = _filled(cells).crossJoin(F.broadcast(ends)) if rows is None or cols is None else _filled(cells)
    rows, cols = F.lit(rows) if rows is not None else F.col("_nr"), F.lit(cols) if cols is not None else F.col("_nc")
    grid = _mirrored(grid, rows, cols, h).withColumn("_q", F.col("_z") * F.col("_z"))
    for line, order in (("row", "col"), ("col", "row")):
        w = Window.partitionBy(line).orderBy(order).rangeBetween(-h, h)
        grid = grid.withColumn("_m", F.avg("_z").over(w) if line == "row" else F.avg("_m").over(w)).withColumn(
            "_v", F.avg("_q").over(w) if line == "row" else F.avg("_v").over(w)
        )
    own = grid.filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    std = F.sqrt(F.greatest(F.col("_v") - F.col("_m") * F.col("_m"), F.lit(0.0)))
    score = F.abs(F.col("_z") - F.col("_m")) / F.when(std == 0, 1e-6).otherwise(std)
    return own.select(*_CELL, F.when(score <= threshold, F.col("z")).alias("z"))


def flats_filter(cells: DataFrame, size: int | None = None) -> DataFrame:
    """z, null where more than `size` cells share its value; without a size the upper fence of frequencies (99th percentile
    and 1.5 ranges). Void cells stay void. Only values above the size are joined back: at most cells / size of them.

    The percentiles meet in one task as counts of distinct frequencies, of which n cells have sqrt(2 n) at most."""
    counts = cells.filter("z is not null").groupBy("z").agg(F.count("*").alias("_n"))
    if size is None:
        q = counts.agg(F.percentile("_n", F.lit(0.01)).alias("lo"), F.percentile("_n", F.lit(0.99)).alias("hi"))
        counts = counts.crossJoin(F.broadcast(q.select((F.col("hi") + 1.5 * (F.col("hi") - F.col("lo"))).alias("_size"))))
    else:
        counts = counts.withColumn("_size", F.lit(size))
    flat = counts.filter("_n > _size").select(F.col("z").alias("_flat"))
    return cells.join(flat, F.col("z") == F.col("_flat"), "left").select(*_CELL, F.when(F.col("_flat").isNull(), F.col("z")).alias("z"))


def _extreme(cells: DataFrame, f, h: int) -> DataFrame:
    for line, order in (("row", "col"), ("col", "row")):
        cells = cells.withColumn("_z", f("_z").over(Window.partitionBy(line).orderBy(order).rangeBetween(-h, h)))
    return cells


def morphology(cells: DataFrame, op: str = "erosion", kernel: int = 3) -> DataFrame:
    """Grey erosion, dilation, opening or closing with a square of ones; cells without data neither give nor take."""
    steps = {"erosion": (F.min,), "dilation": (F.max,), "opening": (F.min, F.max), "closing": (F.max, F.min)}[op]
    out = cells.withColumn("_z", F.col("z"))
    for f in steps:
        out = _extreme(out, f, kernel // 2)
    return out.select(*_CELL, F.when(F.col("z").isNotNull(), F.col("_z")).alias("z"))


def decimate(cells: DataFrame, k: int, bands=("z",)) -> DataFrame:
    """Average pooling of every band over k x k cells."""
    down = [F.floor(F.col(c) / k).cast("int").alias(c) for c in _CELL]
    return cells.groupBy(*down).agg(*[F.avg(b).alias(b) for b in bands])


def blend_background(fine: DataFrame, coarse: DataFrame, k: int, weight: float, method: str = "cell") -> DataFrame:
    """Voids of `fine` (row, col, z, count, weights) from the surface `coarse`, k times as coarse: they get count 1 and `weight`. cell: the value of the
    coarse cell they lie in; cubic: by cubic convolution, for the voids only."""
    if method == "cubic":
        unit, wide = (GridSpec(Region(0.0, 1.0, -1.0, 0.0), float(i), float(i)) for i in (1, k))
        up, keys = fine, _CELL
        bg = align(fine.filter("z IS NULL"), unit, coarse, wide, "cubic").withColumnRenamed("z", "_b")
    else:
        up = fine.withColumn("_r", F.floor(F.col("row") / k).cast("int")).withColumn("_c", F.floor(F.col("col") / k).cast("int"))
        keys, bg = ["_r", "_c"], coarse.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("z").alias("_b"))
    both = up.join(bg, keys, "left")
    fill = F.col("z").isNull() & F.col("_b").isNotNull()
    return both.select(
        *_CELL, F.coalesce("z", "_b").alias("z"),
        F.when(fill, F.lit(1).cast("bigint")).otherwise(F.col("count")).alias("count"), F.when(fill, F.lit(weight)).otherwise(F.col("weights")).alias("weights"),
    )


def auto_stack_mask(cells: DataFrame, min_weight: float) -> DataFrame:
    """z of a statistical stack, null where there is no count or too little weight."""
    keep = (F.col("count") > 0) & (F.col("weights") >= min_weight)
    return cells.select(*_CELL, F.when(keep, F.col("z")).alias("z"))


def _neighbours(cells: DataFrame, reach: int) -> DataFrame:
    """(row, col, z, d2) of every void with each cell with data within `reach`: they meet in square buckets of that side."""
    step = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    down = lambda c: F.floor(F.col(c) / reach).cast("int")
    voids = cells.filter("z IS NULL").select(*_CELL).withColumn("_i", step).withColumn("_j", step)
    voids = voids.select(*_CELL, (down("row") + F.col("_i")).alias("_br"), (down("col") + F.col("_j")).alias("_bc"))
    data = cells.filter("z IS NOT NULL").select(F.col("row").alias("_r"), F.col("col").alias("_c"), "z", down("row").alias("_br"), down("col").alias("_bc"))
    d2 = (F.col("row") - F.col("_r")) * (F.col("row") - F.col("_r")) + (F.col("col") - F.col("_c")) * (F.col("col") - F.col("_c"))
    return voids.join(data.hint("merge"), ["_br", "_bc"]).withColumn("d2", d2).filter(F.col("d2") <= reach * reach)


def fill_idw(cells: DataFrame, reach: int = 4) -> DataFrame:
    """Voids from the cells with data within `reach`, weighted by the inverse squared distance."""
    near = _neighbours(cells, reach).groupBy(*_CELL).agg((F.sum(F.col("z") / F.col("d2")) / F.sum(1 / F.col("d2"))).alias("_f"))
    return cells.join(near, _CELL, "left").select(*_CELL, F.coalesce("z", "_f").alias("z"))


def interp_nearest(cells: DataFrame, reach: int = 4) -> DataFrame:
    """Voids from the nearest cell with data within `reach`, the first by row and column of equals."""
    near = _neighbours(cells, reach).groupBy(*_CELL).agg(F.min_by("z", F.struct("d2", "_r", "_c")).alias("_f"))
    return cells.join(near, _CELL, "left").select(*_CELL, F.coalesce("z", "_f").alias("z"))


def smooth(cells: DataFrame, where: str, passes: int = 1) -> DataFrame:
    """`cells` with z of the rows where the column `where` holds replaced, `passes` times, by the mean of the cells with data in the three by three around."""
    for _ in range(passes):
        cells = cells.withColumn("_s", F.coalesce("z", F.lit(0.0))).withColumn("_n", F.col("z").isNotNull().cast("int"))
        for line, order in (("row", "col"), ("col", "row")):
            w = Window.partitionBy(line).orderBy(order).rangeBetween(-1, 1)
            cells = cells.withColumn("_s", F.sum("_s").over(w)).withColumn("_n", F.sum("_n").over(w))
        cells = cells.withColumn("z", F.when(F.col(where), F.col("_s") / F.col("_n")).otherwise(F.col("z"))).drop("_s", "_n")
    return cells


def fill_quadrants(cells: DataFrame, max_dist: float = 100.0, smoothing: int = 0) -> DataFrame:
    """Voids from the nearest cell with data in each of the four quadrants around, within `max_dist` cells, weighted by the inverse distance; then
    `smoothing` passes over the filled cells only.

    Two sweeps: along columns each cell learns the nearest data above and below it, along rows a void looks at what the cells of its row
    learned, up to `max_dist` to either side. So a void costs its reach, not the square of it. A cell on an axis is in both quadrants beside it; of equally near
    ones the first by row and column counts.
    """
    reach = int(max_dist)
    out = cells.select(*_CELL, "z")
    data = F.when(F.col("z").isNotNull(), F.struct(F.col("row").alias("r"), F.col("z").alias("v")))
    for name, order in (("_up", F.asc("row")), ("_down", F.desc("row"))):
        seen = F.last(data, True).over(Window.partitionBy("col").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(name, F.when(F.abs(seen["r"] - F.col("row")) <= reach, seen))
    around = F.struct(F.col("col").alias("c"), F.col("_up").alias("up"), F.col("_down").alias("down"))
    for name, span in (("_west", (-reach, 0)), ("_east", (0, reach))):
        out = out.withColumn(name, F.collect_list(around).over(Window.partitionBy("row").orderBy("col").rangeBetween(*span)))
    voids = out.filter("z IS NULL")

    def nearest(side: str, way: str):
        def one(x):
            d2 = (x["c"] - F.col("col")) * (x["c"] - F.col("col")) + (x[way]["r"] - F.col("row")) * (x[way]["r"] - F.col("row"))
            return F.when(d2 <= max_dist * max_dist, F.struct(d2.alias("d2"), x[way]["r"].alias("r"), x["c"].alias("c"), x[way]["v"].alias("v")))

        return F.array_min(F.filter(F.transform(side, one), F.isnotnull))

    quads = F.filter(F.array(*[nearest(side, way) for side in ("_west", "_east") for way in ("up", "down")]), F.isnotnull)
    total = lambda q, f: F.aggregate(q, F.lit(0.0), lambda a, x: a + f(x))
    near = voids.select(*_CELL, quads.alias("q"))
    fill = F.try_divide(total(F.col("q"), lambda x: x["v"] / F.sqrt(x["d2"])), total(F.col("q"), lambda x: 1 / F.sqrt(x["d2"])))
    both = cells.select(*_CELL, "z").join(near.select(*_CELL, fill.alias("_f")), _CELL, "left")
    both = both.select(*_CELL, F.coalesce("z", "_f").alias("z"), (F.col("z").isNull() & F.col("_f").isNotNull()).alias("_filled"))
    return smooth(stash(both, "filled"), "_filled", smoothing).select(*_CELL, "z") if smoothing else both.select(*_CELL, "z")


def mosaic(sources: list[tuple[DataFrame, GridSpec]], target: GridSpec, buffer: float = 0.0, method: str = "bilinear", fill: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, GridSpec]:
    """((row, col, z), grid): one grid out of several of any cell size and offset. A cell takes the value of the first source that has one at its centre (see
    `align`); `buffer` widens the target by that much, in whole cells, and `fill` closes gaps, as `fill_idw`. Sources are only asked for the cells of
    their own region, and meet in one aggregation."""
    spark = sources[0][0].sparkSession
    more_x, more_y = (math.ceil(buffer / inc - 1e-9) * inc for inc in (target.xinc, target.yinc))
    r = target.region
    grid = GridSpec(Region(r.w - more_x, r.e + more_x, r.s - more_y, r.n + more_y), target.xinc, target.yinc)
    cells = spark.range(grid.rows * grid.cols).select(F.floor(F.col("id") / grid.cols).cast("int").alias("row"), (F.col("id") % grid.cols).cast("int").alias("col"))
    found = None
    for i, (source, own) in enumerate(sources):
        within = grid.centres(cells).filter(own.region.contains()).select(*_CELL)
        part = align(within, grid, source, own, method).filter("z IS NOT NULL").withColumn("_order", F.lit(i))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(*_CELL).agg(F.min_by("z", "_order").alias("z"))
    out = cells.join(best, _CELL, "left").select(*_CELL, "z")
    return (fill(stash(out, "mosaic")) if fill else out), grid


def ms_cudem_step(cells: DataFrame, k: int, weight: float, reach: int = 4) -> DataFrame:
    """One step of the multi-resolution fill: decimate, fill the coarse surface, and patch the fine voids from it."""
    coarse = fill_idw(decimate(cells, k), reach)
    return blend_background(cells, coarse, k, weight)
