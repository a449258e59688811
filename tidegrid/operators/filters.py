"""Point filters. All but the destructive ones re-label: flagged points of an eligible class get `set_class`.

Statistics are computed over all rows; only the re-labelling looks at `exclude`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegrid.functions.grid import GridSpec, Region, projected


def relabel(points: DataFrame, flagged: Column, set_class: int = 7, exclude=(), invert: bool = False) -> DataFrame:
    """The contract of all filters: (flagged, or with `invert` not) and eligible gets `set_class`."""
    if "classification" not in points.columns:
        points = points.withColumn("classification", F.lit(0))
    hit = F.coalesce(flagged, F.lit(False))
    hit = ~hit if invert else hit
    if exclude:
        hit = hit & ~F.col("classification").isin(list(exclude))
    return points.withColumn("classification", F.when(hit, F.lit(set_class)).otherwise(F.col("classification")))


def range_z(points: DataFrame, min_z: float | None = None, max_z: float | None = None, **more) -> DataFrame:
    """Flag z outside the bounds, which themselves are kept."""
    low = F.col("z") < min_z if min_z is not None else F.lit(False)
    high = F.col("z") > max_z if max_z is not None else F.lit(False)
    return relabel(points, low | high, **more)


def drop_class(points: DataFrame, classes, invert: bool = False) -> DataFrame:
    """Delete the listed classes, or with `invert` all others."""
    listed = [int(c) for c in classes.split("/")] if isinstance(classes, str) else list(classes)
    hit = F.col("classification").isin(listed)
    return points.filter(hit if invert else ~hit)


def spatial_crop(points: DataFrame, region: Region, soft: bool = False, **more) -> DataFrame:
    """Keep points in the closed region; soft: flag the others."""
    return relabel(points, ~region.contains(), **more) if soft else points.filter(region.contains())


def outlierz(points: DataFrame, threshold: float = 3.0, scope=("dataset_id",), **more) -> DataFrame:
    """Flag |z - mean| over `threshold` population deviations of its dataset; groups under 3 points or flat ones pass.

    The statistics are an aggregation joined back, so that no dataset has to fit one task. Points of null dataset are one dataset,
    and no point is lost.
    """
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(scope)]
    stats = points.groupBy(*keys).agg(F.avg("z").alias("_m"), F.stddev_pop("z").alias("_s"), F.count("*").alias("_n"))
    same = F.lit(True)
    for i, k in enumerate(scope):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = points.join(stats, same, "left") if scope else points.crossJoin(F.broadcast(stats))  # one row without a scope
    flag = (F.col("_n") >= 3) & (F.col("_s") > 0) & (F.abs(F.col("z") - F.col("_m")) > threshold * F.col("_s"))
    return relabel(joined, flag, **more).drop("_m", "_s", "_n", *[f"_k{i}" for i in range(len(scope))])


def _best(mode: str, seq: str):
    """What the winner of a block is least by."""
    return {"min": F.struct(F.col("z"), F.col(seq)), "max": F.struct(-F.col("z"), F.col(seq))}.get(mode, F.struct(F.col(seq)))


def block_minmax(points: DataFrame, res: float = 10.0, mode: str = "min", soft: bool = True, seq: str = "seq", origin=(0.0, 0.0), **more) -> DataFrame:
    """One point a block, by least or greatest z (else the first); soft: the others are flagged. Blocks start at `origin`."""
    return _best_of_blocks(points, list(points.columns), res, mode, soft, seq, origin, **more)


def _best_of_blocks(points: DataFrame, columns: list[str], res: float, mode: str, soft: bool, seq: str, origin, **more) -> DataFrame:
    bx = F.floor((F.col("x") - origin[0]) / res).cast("long")
    by = F.floor((F.col("y") - origin[1]) / res).cast("long")
    keyed = points.withColumn("_bx", bx).withColumn("_by", by)
    if not soft:
        whole = F.min_by(F.struct(*columns), _best(mode, seq))
        return keyed.groupBy("_bx", "_by").agg(whole.alias("p")).select("p.*")
    rank = F.row_number().over(Window.partitionBy("_bx", "_by").orderBy(_best(mode, seq)))
    out = relabel(keyed.withColumn("_r", rank), F.col("_r") > 1, **more)
    return out.select(*columns, *[c for c in out.columns if c == "classification" and c not in columns])


def block_thin(points: DataFrame, res: float = 10.0, mode: str = "min", soft: bool = True, seq: str = "seq", **more) -> DataFrame:
    """As block_minmax, with blocks anchored at the least x and y of all points."""
    low = points.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))  # one row
    anchored = points.crossJoin(F.broadcast(low))
    return _best_of_blocks(anchored, list(points.columns), res, mode, soft, seq, (F.col("_x0"), F.col("_y0")), **more)


#: Places of a bucket from which on they are dealt out, and pairs compared at once.
_CROWD, _PAIRS = 8192, 1 << 21
_SUMS = ["n", "sx", "sy", "sz", "sxx", "sxy", "syy", "sxz", "syz"]


def _disc_sums(radius: float):
    """A function of the places of a bucket and those around it to the sums over the disc of each, about it."""

    def run(key: tuple, own: pa.Table, other: pa.Table) -> pa.Table:
        of = lambda t, *names: [t.column(c).to_numpy().astype(float) for c in names]
        (x, y), (u, v, n, z) = of(own, "_x", "_y"), of(other, "_u", "_v", "_n", "_z")
        out = np.zeros((len(x), len(_SUMS)))
        if len(x) and len(u):
            # about the bucket, so that little is lost when the sums are moved to each place
            cx, cy = x[0], y[0]
            a, b = u - cx, v - cy
            terms = np.column_stack((n, n * a, n * b, z, n * a * a, n * a * b, n * b * b, a * z, b * z))
            step = max(1, _PAIRS // len(u))
            for i in range(0, len(x), step):
                dx, dy = u - x[i : i + step, None], v - y[i : i + step, None]
                out[i : i + step] = (dx * dx + dy * dy <= radius * radius).astype(float) @ terms
            c, d = x - cx, y - cy
            m, sx, sy, sz, sxx, sxy, syy, sxz, syz = out.T.copy()
            out = np.column_stack((m, sx - m * c, sy - m * d, sz, sxx - 2 * c * sx + m * c * c, sxy - c * sy - d * sx + m * c * d, syy - 2 * d * sy + m * d * d, sxz - c * sz, syz - d * sz))
        return pa.table({"_x": own.column("_x"), "_y": own.column("_y"), **{k: out[:, i] for i, k in enumerate(_SUMS)}})

    return run


def coplanarz(points: DataFrame, radius: float, threshold: float, min_neighbors: int = 3, seq: str = "seq", **more) -> DataFrame:
    """Flag points off the least-squares plane of the neighbours within `radius` (itself included), or with too few.

    Points at one place are one, with their number and sum of z. Places meet in square buckets of side `radius`, a place being sent to the nine around it; a
    crowded bucket is dealt among several tasks on both sides, whose sums add up. Pairs are compared by numpy and never written. The plane is fitted
    about the point, so its height there is one determinant over another; a degenerate fit flags nothing.
    """
    bucket = lambda c: F.floor(F.col(c) / radius).cast("long")
    places = points.filter("x IS NOT NULL AND y IS NOT NULL").groupBy(F.col("x").alias("_u"), F.col("y").alias("_v")).agg(F.count("*").alias("_n"), F.coalesce(F.sum("z"), F.lit(0.0)).alias("_z"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    sent = places.select("_u", "_v", "_n", "_z", F.explode(steps).alias("_s")).select("_u", "_v", "_n", "_z", (bucket("_u") + F.col("_s.i")).alias("_bx"), (bucket("_v") + F.col("_s.j")).alias("_by"))
    asks = places.select(F.col("_u").alias("_x"), F.col("_v").alias("_y"), bucket("_u").alias("_bx"), bucket("_v").alias("_by"))
    key = ["_bx", "_by"]
    parts = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count("*") / _CROWD).cast("int").alias(name)).filter(F.col(name) > 1)
    crowds = parts(asks, "_p").join(parts(sent, "_q"), key, "full")
    dealt = lambda df: df.join(crowds, key, "left").na.fill(1, ["_p", "_q"])
    mine = lambda c, n, *at: F.pmod(F.xxhash64(*at), F.col(n)).cast("int").alias(c)
    every = lambda c, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(c)
    asks = dealt(asks).select("_x", "_y", *key, "_q", mine("_i", "_p", "_x", "_y")).select("_x", "_y", *key, "_i", every("_j", "_q"))
    sent = dealt(sent).select("_u", "_v", "_n", "_z", *key, "_p", mine("_j", "_q", "_u", "_v")).select("_u", "_v", "_n", "_z", *key, "_j", every("_i", "_p"))
    group = [*key, "_i", "_j"]
    met = asks.groupBy(*group).cogroup(sent.groupBy(*group)).applyInArrow(_disc_sums(radius), "_x double, _y double, " + ", ".join(f"{k} double" for k in _SUMS))
    sums = met.groupBy("_x", "_y").agg(*[F.sum(k).alias(k) for k in _SUMS])
    det = F.expr("n*(sxx*syy-sxy*sxy) - sx*(sx*syy-sxy*sy) + sy*(sx*sxy-sxx*sy)")
    top = F.expr("sz*(sxx*syy-sxy*sxy) - sx*(sxz*syy-sxy*syz) + sy*(sxz*sxy-sxx*syz)")
    fit = sums.select(F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("n").alias("_n"), F.when(F.abs(det) > 1e-12, top / det).alias("_fit"))
    flag = (F.col("_n") < min_neighbors + 1) | (F.abs(F.col("z") - F.col("_fit")) > threshold)
    columns = points.columns
    return relabel(points.join(fit, ["x", "y"], "left"), flag, **more).select(*columns, *([] if "classification" in columns else ["classification"]))


def sample(points: DataFrame, cells: DataFrame, grid: GridSpec, value: str, name: str = "ref") -> DataFrame:
    """`points` with the value of the cell each lies in, null where there is none."""
    ref = cells.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col(value).alias(name))
    keyed = points.withColumn("_row", grid.row()).withColumn("_col", grid.col())
    return keyed.join(ref, ["_row", "_col"], "left").drop("_row", "_col")


def raster_mask(points: DataFrame, cells: DataFrame, grid: GridSpec, value: str, invert: bool = False, **more) -> DataFrame:
    """Flag points outside the mask (value 0 or none), or with `invert` inside."""
    s = sample(points, cells, grid, value, "_m")
    return relabel(s, F.coalesce(F.col("_m"), F.lit(0.0)) == 0, invert=invert, **more).drop("_m")


def diffz(points: DataFrame, cells: DataFrame, grid: GridSpec, value: str, min_diff: float, max_diff: float, invert: bool = False, **more) -> DataFrame:
    """Keep z - reference within the bounds; flag the rest, also where there is no reference."""
    s = sample(points, cells, grid, value, "_m")
    keep = F.coalesce((F.col("z") - F.col("_m")).between(min_diff, max_diff), F.lit(False))
    return relabel(s, ~keep, invert=invert, **more).drop("_m")


def rq(points: DataFrame, cells: DataFrame, grid: GridSpec, value: str, threshold: float = 10.0, mode: str = "diff", **more) -> DataFrame:
    """Flag points too far from the reference, by difference or percent; only where there is a reference. In percent mode a
    reference of 0 flags any other z."""
    s = sample(points, cells, grid, value, "_m")
    off = F.abs(F.col("z") - F.col("_m"))
    if mode == "percent":
        flag = F.when(F.col("_m") == 0, off > 0).otherwise(F.try_divide(off, F.abs(F.col("_m"))) * 100 > threshold)
    else:
        flag = off > threshold
    return relabel(s, flag, **more).drop("_m")


def in_polygon(rings: list[list[tuple[float, float]]], x: str = "x", y: str = "y") -> Column:
    """Even-odd rule over all rings, so holes are outside. An expression as long as the rings: for a few dozen edges; `vector_mask`
    takes any number."""
    crossings = F.lit(0)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if y1 != y2:
                spans = (F.lit(y1) > F.col(y)) != (F.lit(y2) > F.col(y))
                left = F.col(x) < (x2 - x1) * (F.col(y) - y1) / (y2 - y1) + x1
                crossings = crossings + (spans & left).cast("int")
    return crossings % 2 == 1


def vector_mask(points: DataFrame, polygons: list | DataFrame, invert: bool = False, seq: str = "seq", **more) -> DataFrame:
    """Flag points inside any polygon (a list of rings each), or with `invert` outside all. `polygons` may also be a table of edges
    (poly, x1, y1, x2, y2)."""
    edges = polygons if isinstance(polygons, DataFrame) else polygon_edges(points.sparkSession, polygons)
    marked = points.join(inside_polygons(points, edges, seq).withColumn("_in", F.lit(True)), seq, "left")
    return relabel(marked, F.coalesce("_in", F.lit(False)), invert=invert, **more).drop("_in")


def polygon_edges(spark, polygons: list) -> DataFrame:
    """The edges (poly, x1, y1, x2, y2) of polygons, a list of rings each."""
    rows = [(i, *map(float, (*a, *b))) for i, rings in enumerate(polygons) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
    return spark.createDataFrame(rows, "poly long, x1 double, y1 double, x2 double, y2 double")


#: Points of a band from which on they are dealt among so many tasks.
_BUSY, _PARTS = 100_000, 16


def crossings(points: DataFrame, edges: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq, poly, n): how many edges of each polygon lie to the right of a point at its height, where there are any.

    Points and edges meet in bands of y, so a point is compared only with edges at its height. There are as many bands as make the edges' spans twice
    their number at most, so tall edges do not multiply; a band of many points is dealt among `_PARTS` tasks. Crossings are aggregated before they move.
    """
    level = edges.filter("y1 <> y2").withColumn("_lo", F.least("y1", "y2")).withColumn("_hi", F.greatest("y1", "y2"))
    high = F.max("_hi") - F.min("_lo")
    bands = F.greatest(F.lit(1), F.floor(F.count("*") * high / F.sum(F.col("_hi") - F.col("_lo"))))
    shape = level.agg(F.min("_lo").alias("_y0"), high.alias("_high"), bands.cast("long").alias("_bands"))  # one row
    band = lambda y: F.floor((F.col(y) - F.col("_y0")) / F.col("_high") * F.col("_bands")).cast("long")
    level = level.crossJoin(F.broadcast(shape)).select("poly", "x1", "y1", "x2", "y2", F.explode(F.sequence(band("_lo"), band("_hi"))).alias("_band"))
    own = points.select(F.col(seq).alias("_s"), F.col("x").alias("_px"), F.col("y").alias("_py")).crossJoin(F.broadcast(shape)).withColumn("_band", band("_py"))
    busy = own.groupBy("_band").agg(F.count("*").alias("_n")).filter(F.col("_n") > _BUSY).select("_band", F.lit(_PARTS).alias("_parts"))
    parts = lambda df: df.join(busy, "_band", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    own = parts(own).withColumn("_part", F.pmod(F.xxhash64("_s", "_px"), F.col("_parts")).cast("int"))
    level = parts(level).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    met = own.select("_s", "_px", "_py", "_band", "_part").join(level.drop("_parts"), ["_band", "_part"])
    spans = (F.col("y1") > F.col("_py")) != (F.col("y2") > F.col("_py"))
    left = F.col("_px") < (F.col("x2") - F.col("x1")) * (F.col("_py") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    return met.filter(spans & left).groupBy(F.col("_s").alias(seq), "poly").agg(F.count("*").alias("n"))


def inside_polygons(points: DataFrame, edges: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq) of the points inside any polygon, by the even-odd rule over its edges: an odd number of them to the right is inside."""
    return crossings(points, edges, seq).filter("n % 2 = 1").select(seq).distinct()


def beam_quality(beams: DataFrame) -> DataFrame:
    """Soundings of good beams."""
    return beams.filter("beamflag = 0 AND speed > 2 AND abs(roll) < 10 AND abs(seafloor_grazing_angle) > 20 AND abs(crosstrack_slope) < 50")


def reproject(points: DataFrame, to: str, source: str = "geographic", shift: DataFrame | None = None, grid: GridSpec | None = None, value: str = "shift", seq: str = "seq") -> DataFrame:
    """`points` in another horizontal system. With a table `shift` of cells of `grid` in degrees, z is raised by its bilinear value at the
    point's degrees; points without one there keep no z (null)."""
    degrees = projected(points, "geographic", source)
    if shift is not None:
        by = sample_bilinear(degrees, shift, grid, value, "_shift", seq)
        degrees = degrees.join(by, seq, "left").withColumn("z", F.col("z") + F.col("_shift")).drop("_shift")
    return projected(degrees, to, "geographic")


def sample_bilinear(points: DataFrame, cells: DataFrame, grid: GridSpec, value: str, name: str = "ref", seq: str = "seq") -> DataFrame:
    """(seq, name): bilinear between the centres of the four cells around each point; null where one of them is missing."""
    fx = (F.col("x") - grid.region.w) / grid.xinc - 0.5
    fy = (F.lit(grid.region.n) - F.col("y")) / grid.yinc - 0.5
    at = points.select(seq, F.floor(fx).alias("_c"), F.floor(fy).alias("_r"), (fx - F.floor(fx)).alias("_a"), (fy - F.floor(fy)).alias("_b"))
    corner = lambda dr, dc: F.struct(
        (F.col("_r") + dr).cast("int").alias("_row"), (F.col("_c") + dc).cast("int").alias("_col"),
        ((F.col("_b") if dr else 1 - F.col("_b")) * (F.col("_a") if dc else 1 - F.col("_a"))).alias("_w"),
    )
    four = at.select(seq, F.inline(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1)))).filter("_w > 1e-7")
    ref = cells.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col(value).alias("_v"))
    met = four.join(ref, ["_row", "_col"], "left").groupBy(seq)
    whole = F.count("_v") == F.count("*")
    return met.agg(F.when(whole, F.sum(F.col("_w") * F.col("_v"))).alias(name))


def _near(t: Column) -> Column:
    return (t * 1.5 - 2.5) * t * t + 1


def _far(t: Column) -> Column:
    return ((t * -0.5 + 2.5) * t - 4) * t + 2


def cubic_weight(t: Column) -> Column:
    """The cubic convolution kernel at a distance of t cells: 1 at 0, 0 at other whole numbers and from 2 on; its weights sum to 1."""
    t = F.abs(t)
    return F.when(t <= 1, _near(t)).when(t < 2, _far(t)).otherwise(F.lit(0.0))


def _four_weights(t: Column) -> list[Column]:
    """The kernel from one cell before to two after, at t of a cell (0 <= t < 1)."""
    return [_far(t + 1), _near(t), _near(1 - t), _far(2 - t)]


def _four_by_four(cells: DataFrame, value: str) -> DataFrame:
    """(_r, _c, _v00 to _v33): the values from one line before to two after the cell (_r, _c), for all cells with data around. Lines first, then across: a cell
    makes four rows each time."""
    four = F.explode(F.array(*[F.lit(i) for i in range(4)]))
    cells = cells.filter(F.col(value).isNotNull()).select(F.col("row").cast("long").alias("_row"), F.col("col").cast("long").alias("_col"), F.col(value).alias("_v"), four.alias("_i"))
    lines = cells.groupBy("_row", (F.col("_col") + 1 - F.col("_i")).alias("_c")).agg(*[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(f"_v{i}") for i in range(4)])
    across = lines.withColumn("_j", four).groupBy((F.col("_row") + 1 - F.col("_j")).alias("_r"), "_c")
    return across.agg(*[F.max(F.when(F.col("_j") == j, F.col(f"_v{i}"))).alias(f"_v{j}{i}") for j in range(4) for i in range(4)])


def sample_cubic(points: DataFrame, cells: DataFrame, grid: GridSpec, value: str, name: str = "ref", seq: str | Sequence[str] = "seq", least: float = 0.25) -> DataFrame:
    """(seq, name): cubic convolution over the four by four cells around each point, of a grid of any cell size. Beside voids and edges the weights of the
    cells with data are renewed to sum to 1; null where they sum to less than `least` before, so never in a cell with data
    that has data around. Weights are one product of row and column. A point is one row that meets its sixteen cells in one; `seq` may be several columns, which it keeps."""
    keep = [seq] if isinstance(seq, str) else list(seq)
    fx = (F.col("x") - grid.region.w) / grid.xinc - 0.5
    fy = (F.lit(grid.region.n) - F.col("y")) / grid.yinc - 0.5
    at = points.select(*keep, fx.alias("_fx"), fy.alias("_fy")).withColumn("_r", F.floor("_fy")).withColumn("_c", F.floor("_fx"))
    met = at.join(_four_by_four(cells, value).hint("merge"), ["_r", "_c"], "left")
    met = met.withColumns({f"_{axis}{i}": w for axis, f, c in (("y", "_fy", "_r"), ("x", "_fx", "_c")) for i, w in enumerate(_four_weights(F.col(f) - F.col(c)))})
    # short expressions: the JVM does not compile a long method
    value = lambda j, i: F.col(f"_v{j}{i}")
    across = lambda term: reduce(add, [F.col(f"_y{j}") * reduce(add, [term(j, i) for i in range(4)]) for j in range(4)])
    sums = {"_sum": across(lambda j, i: F.when(value(j, i).isNotNull(), F.col(f"_x{i}")).otherwise(0.0)), "_top": across(lambda j, i: F.coalesce(F.col(f"_x{i}") * value(j, i), F.lit(0.0)))}
    met = met.select(*keep, *[c.alias(n) for n, c in sums.items()])
    return met.select(*keep, F.when((F.col("_sum") >= least) & (F.col("_sum") != 0), F.col("_top") / F.col("_sum")).alias(name))
