"""Interpolation of voids over the Delaunay triangles of the cells with data, linear or cubic (Clough-Tocher), by tile.

Only cells beside a void can be corners of a triangle that covers one; they, and the corners of the convex hull of all data, are what
tiles look at. A tile has its own such cells and those of a halo, and finds for each of its voids the triangle around it whose
circumcircle holds none of them. Voids whose circle leaves what the tile has seen are looked at again with a halo as wide as a tile. Circles that
leave that too are compared with all cells, in buckets of about the circle's size,
and the cell that lies deepest in each is handed to the tile, which looks again; until no circle holds an unseen cell. So
the triangles are those of the whole grid, though no task holds more than a tile with its halo and what was handed to it.

Data on a grid are often on one circle. Ties are broken as if the distance along columns counted a little more, and beyond that as if the axes were
not quite square: x*x + y*y + e*x*x + e*e*x*y for an e as small as one likes. That leaves one triangulation, the same in every tile.
Voids outside the hull stay void, and all do where the data lie on one line.

Corners of the hull come from task by task hulls of the rows' ends. They are held by the driver and every tile: a convex polygon of
whole numbers within n cells has fewer than 4 * n ** (2 / 3) corners.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidegrid.functions.shared import stash

_CELL = ["row", "col"]
_POINT = [*_CELL, "z", "gx", "gy"]
#: Cells around a void whose data its triangle is first looked for in.
_NEAR = 4
#: Tiles a task.
_TILES = 8
_FOUND = "row int, col int, ti int, tj int, value double, sure boolean, r1 int, c1 int, r2 int, c2 int, r3 int, c3 int"


def rim(cells: DataFrame) -> DataFrame:
    """(row, col, z) of the cells with data that have a void among the eight around them."""
    out = cells.select(*_CELL, "z").withColumn("_full", F.col("z").isNotNull())
    for line, order in (("row", "col"), ("col", "row")):
        out = out.withColumn("_full", F.min("_full").over(Window.partitionBy(line).orderBy(order).rangeBetween(-1, 1)))
    return out.filter("z IS NOT NULL AND NOT _full").drop("_full")


def _half_hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in points:
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
            out.pop()
        out.append(p)
    return out


def hull_of(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Corners of the convex hull of (x, y), against the clock; fewer than three where all lie on one line."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    out = _half_hull(points)[:-1] + _half_hull(points[::-1])[:-1]
    return out if len(out) > 2 else out[:2]


def hull(cells: DataFrame) -> list[tuple[int, int]]:
    """(col, row) of the corners of the convex hull of the cells with data."""
    ends = cells.filter("z IS NOT NULL").groupBy("row").agg(F.min("col").alias("low"), F.max("col").alias("high"))

    def run(batches):
        held: list[tuple[int, int]] = []
        for b in batches:
            for row, low, high in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                held += [(low, row), (high, row)]
            held = hull_of(held)
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in held], pa.int32()), pa.array([p[1] for p in held], pa.int32())], names=["col", "row"])

    parts = ends.select("row", "low", "high").mapInArrow(run, "col int, row int").collect()
    return hull_of([(r["col"], r["row"]) for r in parts])


def _cross(ax, ay, bx, by):
    return ax * by - ay * bx


class Sides:
    """On which side of a line a place lies that is moved by less than anything towards the middle of the hull, so that it lies on no line."""

    def __init__(self, corners: np.ndarray):
        a, b, c = corners[0], corners[len(corners) // 3], corners[2 * len(corners) // 3]
        self.middle = a + b + c

    def of(self, a: np.ndarray, b: np.ndarray, v: np.ndarray) -> np.ndarray:
        """1 where v is left of the way from a to b, else -1; arrays (.., 2) of whole numbers."""
        dx, dy = b[..., 0] - a[..., 0], b[..., 1] - a[..., 1]
        side = np.sign(_cross(dx, dy, v[..., 0] - a[..., 0], v[..., 1] - a[..., 1]))
        tx, ty = self.middle[0] - 3 * v[..., 0], self.middle[1] - 3 * v[..., 1]
        still = (tx == 0) & (ty == 0)
        tx = np.where(still, 1, tx)
        side = np.where(side == 0, np.sign(_cross(dx, dy, tx, ty)), side)
        return np.where(side == 0, np.sign(_cross(dx, dy, -ty, tx)), side)


def _exact(p: list[list[int]], q: list[int]) -> tuple[int, int, int]:
    """How high q lies over the plane through three lifted points against the clock, times a positive number; then by what breaks ties."""
    (x0, y0), (x1, y1), (x2, y2) = p
    jx, jy, kx, ky, x, y = x1 - x0, y1 - y0, x2 - x0, y2 - y0, q[0] - x0, q[1] - y0
    area = jx * ky - jy * kx
    return tuple(
        area * lift(x, y) - x * (lift(jx, jy) * ky - lift(kx, ky) * jy) - y * (jx * lift(kx, ky) - kx * lift(jx, jy))
        for lift in (lambda x, y: x * x + y * y, lambda x, y: x * x, lambda x, y: x * y)
    )


def _lifted(i: np.ndarray, j: np.ndarray, k: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How high points x, y (n, m) lie over the planes through three lifted points (n, 2) against the clock, times a positive number, and what may be rounding in that:
    beyond 2**53 numbers are not exact."""
    x, y, j, k = x - i[:, 0, None], y - i[:, 1, None], j - i, k - i
    area, jj, kk = _cross(*j.T, *k.T)[:, None], (j * j).sum(1), (k * k).sum(1)
    up, ax, by = area * (x * x + y * y), (jj * k[:, 1] - kk * j[:, 1])[:, None] * x, (j[:, 0] * kk - k[:, 0] * jj)[:, None] * y
    return up - (ax + by), (np.abs(up) + np.abs(ax + by) + np.abs(ax)) * 1e-14


def _lowest(points: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """For each triangle (corners' numbers, against the clock) the point deepest in its circle, -1 without one."""
    p = points.astype(float)
    out = np.full(len(tri), -1)
    step = max(1, (1 << 18) // max(1, len(p)))  # small arrays stay in a core's cache
    for s in range(0, len(tri), step):
        # what may be zero is looked at again in whole numbers
        high, slack = _lifted(*(p[tri[s : s + step, c]] for c in range(3)), p[:, 0], p[:, 1])
        best = high.argmin(1)
        rows = np.arange(len(best))
        clear = high[rows, best] < -slack[rows, best]
        out[s : s + step] = np.where(clear, best, -1)
        for r in np.flatnonzero(~clear):
            corners = tri[s + r]
            near = [q for q in np.flatnonzero(np.abs(high[r]) <= slack[r]) if q not in corners]
            if near:
                at = points[corners].tolist()
                least, q = min((_exact(at, points[q].tolist()), q) for q in near)
                if least < (0, 0, 0):
                    out[s + r] = q
    return out


def _turned(points: np.ndarray, tri: np.ndarray, q: np.ndarray, voids: np.ndarray, sides: Sides) -> np.ndarray:
    """Of the triangles that the points q in them or beyond them make with two corners, those around the voids."""
    new, s = tri.copy(), [sides.of(points[q], points[tri[:, i]], voids) for i in range(3)]
    for i in range(3):  # the void lies in the triangle of q and the corners i and i + 1
        hit = (s[i] > 0) & (s[(i + 1) % 3] < 0)
        new[hit] = np.stack((tri[hit, i], tri[hit, (i + 1) % 3], q[hit]), 1)
    return new


def _begun(points: np.ndarray, tri: np.ndarray, voids: np.ndarray, sides: Sides) -> np.ndarray:
    """The triangles `tri` around voids, turned until no point within `_NEAR` cells of its void lies in the circle of any, ties aside."""
    p, low = points.astype(float), voids.min(0) - _NEAR
    shape = voids.max(0) + _NEAR + 1 - low
    held, grid = np.flatnonzero(((points >= low) & (points < low + shape)).all(1)), np.full(shape, -1)
    grid[tuple((points[held] - low).T)] = held
    dx, dy = (d.ravel() for d in np.mgrid[-_NEAR : _NEAR + 1, -_NEAR : _NEAR + 1])
    tri = tri.copy()
    for s in range(0, len(voids), 4096):
        v = voids[s : s + 4096]
        near, active = grid[v[:, 0, None] - low[0] + dx, v[:, 1, None] - low[1] + dy], np.arange(len(v))
        while len(active):
            t, n = tri[s + active], near[active]
            high, slack = _lifted(*(p[t[:, c]] for c in range(3)), p[n, 0], p[n, 1])
            high = np.where((n >= 0) & (high < -slack), high, 0)
            best = high.argmin(1)
            some = high[np.arange(len(best)), best] < 0
            active, q = active[some], n[some, best[some]]
            tri[s + active] = _turned(points, t[some], q, v[active], sides)
    return tri


def enclosing(points: np.ndarray, voids: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """For each void the numbers of its Delaunay triangle's corners, against the clock; -1 outside the hull. `points` (n, 2) x and y, distinct; `corners`:
    numbers of the hull's corners among them, in order against the clock."""
    sides, out = Sides(points[corners]), np.full((len(voids), 3), -1)
    fan = points[corners]
    left = sides.of(fan[0], fan[1:][None], voids[:, None])  # falls from 1 to -1 within the hull
    n = (left > 0).sum(1)
    inside = (left[:, 0] > 0) & (left[:, -1] < 0)
    first = np.clip(n - 1, 0, len(corners) - 3)
    inside &= sides.of(fan[1 + first], fan[2 + first], voids) > 0
    start = np.stack((np.full(len(voids), corners[0]), corners[1 + first], corners[2 + first]), 1)
    todo = np.flatnonzero(inside)
    if len(todo):
        start[todo] = _begun(points, start[todo], voids[todo], sides)
    todo = todo[np.argsort(todo * 0x9E3779B1 % (1 << 32), kind="stable")]  # spread over the tile
    while len(todo):
        part, todo = todo[:256], todo[256:]
        tri, active = start[part], np.arange(len(part))
        while len(active):
            one, same = np.unique(np.take_along_axis(tri[active], (tri[active].argmin(1)[:, None] + np.arange(3)) % 3, 1), axis=0, return_inverse=True)
            q = _lowest(points, one)[same.ravel()]
            active, q = active[q >= 0], q[q >= 0]
            if not len(active):
                break
            tri[active] = _turned(points, tri[active], q, voids[part[active]], sides)
        out[part] = tri
        # most other voids lie in a triangle that is known now
        known = np.unique(tri, axis=0)
        for s in range(0, len(todo), 4096):
            some = todo[s : s + 4096]
            v = voids[some][:, None]
            a, b, c = (points[known[:, i]][None] for i in range(3))
            held = (sides.of(a, b, v) > 0) & (sides.of(b, c, v) > 0) & (sides.of(c, a, v) > 0)
            hit = held.any(1)
            out[some[hit]] = known[held.argmax(1)[hit]]
        todo = todo[out[todo, 0] < 0]
    return out


def barycentric(p: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(n, 3) weights of the corners p (n, 3, 2) at v (n, 2)."""
    a, b, c = (p[:, i].astype(float) for i in range(3))
    area = _cross(*(b - a).T, *(c - a).T)
    one = _cross(*(b - v).T, *(c - v).T) / area
    two = _cross(*(c - v).T, *(a - v).T) / area
    return np.stack((one, two, 1 - one - two), 1)


def clough_tocher(p: np.ndarray, f: np.ndarray, g: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Values of the reduced Clough-Tocher cubic: corners p (n, 3, 2), values f (n, 3), gradients g (n, 3, 2), at barycentric w (n, 3). A triangle is split
    at its centroid; the derivative across an edge is linear along it, so neighbours meet smoothly and quadratics come back."""
    p = p.astype(float)
    centre = p.mean(1)
    edge, inner, mid = {}, [], {}
    for i in range(3):
        inner.append(f[:, i] + (g[:, i] * (centre - p[:, i])).sum(1) / 3)
        for j in range(3):
            if i != j:
                edge[i, j] = f[:, i] + (g[:, i] * (p[:, j] - p[:, i])).sum(1) / 3
    for i, j in ((0, 1), (1, 2), (2, 0)):
        e = p[:, j] - p[:, i]
        along = ((centre - p[:, i]) * e).sum(1) / (e * e).sum(1)
        d0 = inner[i] - f[:, i] - along * (edge[i, j] - f[:, i])
        d2 = inner[j] - edge[j, i] - along * (f[:, j] - edge[j, i])
        mid[i, j] = mid[j, i] = edge[i, j] + along * (edge[j, i] - edge[i, j]) + (d0 + d2) / 2
    deep = [(inner[i] + mid[i, (i + 1) % 3] + mid[i, (i + 2) % 3]) / 3 for i in range(3)]
    middle = (deep[0] + deep[1] + deep[2]) / 3
    out, least = np.zeros(len(f)), w.argmin(1)
    for k in range(3):
        i, j = (k + 1) % 3, (k + 2) % 3
        c, a, b = 3 * w[:, k], w[:, i] - w[:, k], w[:, j] - w[:, k]
        value = a**3 * f[:, i] + b**3 * f[:, j] + c**3 * middle + 3 * a * a * b * edge[i, j] + 3 * a * b * b * edge[j, i]
        value += 3 * c * (a * a * inner[i] + b * b * inner[j]) + 3 * c * c * (a * deep[i] + b * deep[j]) + 6 * a * b * c * mid[i, j]
        out = np.where(least == k, value, out)
    return out


def gradients(points: DataFrame, cells: DataFrame, reach: int = 2) -> DataFrame:
    """`points` (row, col, z) with the slopes gx and gy of the plane through each that fits the data within `reach` cells best, weighted by the inverse
    squared distance; null where those do not make a plane. Exact for planes."""
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i or j]
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i, j in steps]))
    asked = points.select(*[F.col(c).alias(f"_{c}") for c in (*_CELL, "z")], around.alias("s"))
    asked = asked.select("*", (F.col("_row") + F.col("s.dy")).alias("row"), (F.col("_col") + F.col("s.dx")).alias("col"))
    met = asked.join(cells.filter("z IS NOT NULL").select(*_CELL, "z"), _CELL)
    dx, dy, dz = F.col("s.dx"), F.col("s.dy"), F.col("z") - F.col("_z")
    w = 1 / (dx * dx + dy * dy)
    sums = met.groupBy("_row", "_col").agg(*[F.sum(w * a * b).alias(n) for n, a, b in (("xx", dx, dx), ("xy", dx, dy), ("yy", dy, dy), ("xz", dx, dz), ("yz", dy, dz))])
    det = F.expr("xx * yy - xy * xy")
    fit = lambda e: F.when(det > F.expr("1e-9 * xx * yy"), F.try_divide(F.expr(e), det))
    sums = sums.select(F.col("_row").alias("row"), F.col("_col").alias("col"), fit("xz * yy - yz * xy").alias("gx"), fit("yz * xx - xz * xy").alias("gy"))
    return points.join(sums, _CELL, "left").select(*_POINT)


def _solve(corners: np.ndarray, heights: np.ndarray, tile: int, halo: int, cubic: bool):
    """A function of a tile's voids and points to the values of the voids; `sure` where the triangle's circle lies within what the tile has seen."""

    def run(key: tuple, voids: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        if not len(voids):
            return pd.DataFrame({n: [] for n in names})
        ti, tj = key
        held = np.concatenate((np.column_stack((corners, heights)), points[["col", "row", "z", "gx", "gy"]].to_numpy(float)))
        at, first = np.unique(held[:, :2].astype(np.int64), axis=0, return_index=True)
        held = held[first]
        place = {tuple(p): i for i, p in enumerate(at.tolist())}
        own = np.array([place[tuple(c)] for c in corners.tolist()])
        origin = np.array([tj * tile, ti * tile])
        v = voids[["col", "row"]].to_numpy(np.int64)
        tri = enclosing(at - origin, v - origin, own)
        inside = tri[:, 0] >= 0
        v, tri = v[inside], tri[inside]
        p, f = at[tri], held[tri, 2]
        w = barycentric(p, v)
        value = (w * f).sum(1)
        if cubic and len(v):
            g = held[tri, 3:5]
            # the triangle's own slopes where a corner has none
            q = p.astype(float)
            (ax, ay), (bx, by) = (q[:, 1] - q[:, 0]).T, (q[:, 2] - q[:, 0]).T
            da, db, area = f[:, 1] - f[:, 0], f[:, 2] - f[:, 0], _cross(*(q[:, 1] - q[:, 0]).T, *(q[:, 2] - q[:, 0]).T)
            flat = np.stack(((da * by - db * ay) / area, (ax * db - bx * da) / area), 1)
            g = np.where(np.isnan(g).any(2)[:, :, None], flat[:, None, :], g)
            value = clough_tocher(p, f, g, w)
        centre, radius = circles(p.astype(float))
        low, high = origin - halo, origin + tile + halo - 1
        sure = ((centre - radius[:, None] >= low) & (centre + radius[:, None] <= high)).all(1)
        return pd.DataFrame(
            {"row": v[:, 1], "col": v[:, 0], "ti": ti, "tj": tj, "value": value, "sure": sure,
             **{f"{n}{i + 1}": p[:, i, k] for i in range(3) for n, k in (("r", 1), ("c", 0))}}
        )[names]

    return run


def circles(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and radii, a little on the large side, of the circles through (n, 3, 2) corners."""
    i, j, k = p[:, 0], p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]
    area = 2 * _cross(*j.T, *k.T)
    jj, kk = (j * j).sum(1), (k * k).sum(1)
    centre = np.stack(((jj * k[:, 1] - kk * j[:, 1]) / area, (j[:, 0] * kk - k[:, 0] * jj) / area), 1)
    return centre + i, np.sqrt((centre * centre).sum(1)) * (1 + 1e-9) + 1e-6


def _unseen(found: DataFrame, points: DataFrame, known: DataFrame, tile: int, halo: int, size: int) -> DataFrame:
    """(ti, tj, row, col): the point deepest in the circle of each triangle that is not sure, among those that its tile does not know."""
    d = {f"{n}{i}": f"CAST({n}{i} - {n}1 AS DOUBLE)" for n in "rc" for i in (2, 3)}
    tri = found.filter("NOT sure").select("ti", "tj", *[f"{n}{i}" for i in (1, 2, 3) for n in "rc"]).distinct()
    tri = tri.withColumn("area", F.expr(f"{d['c2']} * {d['r3']} - {d['r2']} * {d['c3']}"))
    jj, kk = (f"({d[f'c{i}']} * {d[f'c{i}']} + {d[f'r{i}']} * {d[f'r{i}']})" for i in (2, 3))
    tri = tri.withColumn("a", F.expr(f"{jj} * {d['r3']} - {kk} * {d['r2']}")).withColumn("b", F.expr(f"{d['c2']} * {kk} - {d['c3']} * {jj}"))
    cx, cy = F.col("c1") + F.col("a") / (2 * F.col("area")), F.col("r1") + F.col("b") / (2 * F.col("area"))
    radius = F.sqrt(F.pow(F.col("a"), 2) + F.pow(F.col("b"), 2)) / (2 * F.col("area")) * (1 + 1e-9) + 1e-6
    tri = tri.withColumn("x", cx).withColumn("y", cy).withColumn("radius", radius)
    clip = lambda e: F.greatest(F.lit(-1.0), F.least(F.lit(size + 1.0), e))
    for n, c in (("col", "x"), ("row", "y")):
        tri = tri.withColumn(f"low_{n}", F.floor(clip(F.col(c) - F.col("radius")))).withColumn(f"high_{n}", F.ceil(clip(F.col(c) + F.col("radius"))))
    # buckets of the circle's own size or up to twice that: it meets four at most
    wide = F.greatest(F.col("high_col") - F.col("low_col"), F.col("high_row") - F.col("low_row"), F.lit(tile))
    tri = tri.withColumn("level", F.ceil(F.log2(wide / tile)).cast("int"))
    tri = stash(tri.withColumn("side", (F.lit(tile) * F.pow(F.lit(2.0), "level")).cast("long")), "triangles")
    levels = sorted(r["level"] for r in tri.select("level").distinct().collect())  # log2(size / tile) of them at most
    if not levels:
        return known.limit(0)
    bucket = lambda c: F.floor(F.col(c) / F.col("side")).cast("int")
    spans = [F.explode(F.sequence(bucket(f"low_{n}"), bucket(f"high_{n}"))).alias(f"b_{n}") for n in _CELL]
    tri = tri.select("*", spans[0]).select("*", spans[1])
    sides = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.lit(tile << level).cast("long").alias("side")) for level in levels]))
    placed = points.select(*_CELL, sides.alias("s")).select(*_CELL, "s.level", "s.side").withColumn("b_row", bucket("row")).withColumn("b_col", bucket("col")).drop("side")
    met = placed.join(tri, ["level", "b_row", "b_col"])
    x, y = F.col("col") - F.col("c1"), F.col("row") - F.col("r1")
    met = met.withColumn("high", F.col("area") * (x * x + y * y) - F.col("a") * x - F.col("b") * y)
    slack = (F.col("area") * (x * x + y * y) + F.abs(F.col("a") * x) + F.abs(F.col("b") * y)) * 1e-14
    away = lambda n, t: (F.col(n) < F.col(t) * tile - halo) | (F.col(n) >= (F.col(t) + 1) * tile + halo)
    met = met.filter((F.col("high") <= slack) & (away("row", "ti") | away("col", "tj")))
    met = met.join(known, ["ti", "tj", *_CELL], "left_anti")
    best = met.groupBy("ti", "tj", *[f"{n}{i}" for i in (1, 2, 3) for n in "rc"]).agg(F.min_by(F.struct(*_CELL), F.struct("high", *_CELL)).alias("p"))
    return best.select("ti", "tj", "p.row", "p.col").distinct()


def _filled(cells: DataFrame, found: DataFrame) -> DataFrame:
    """`cells` with the values found for voids."""
    return cells.join(found.select(*_CELL, "value"), _CELL, "left").select(*_CELL, F.coalesce("z", "value").alias("z"))


def interp_triangles(cells: DataFrame, method: str = "linear", tile: int = 64, halo: int = 16, reach: int = 2) -> DataFrame:
    """(row, col, z) with the voids inside the hull of the data filled over Delaunay triangles: linear, or cubic with slopes fitted within `reach`.
    `cells` holds a row for every cell of the grid. Of data on one line, or without any void or data, the cells come back as they are."""
    if method not in ("linear", "cubic"):
        raise ValueError(f"no method {method}")
    cells = cells.select(*_CELL, "z")
    ends = hull(cells)
    if len(ends) < 3:
        return cells
    corner = cells.sparkSession.createDataFrame([(r, c) for c, r in ends], "row int, col int")
    data = cells.filter("z IS NOT NULL")
    points = rim(cells).unionByName(data.join(corner, _CELL, "left_semi")).dropDuplicates(_CELL)
    points = gradients(points, cells, reach) if method == "cubic" else points.select("*", *[F.lit(None).cast("double").alias(g) for g in ("gx", "gy")])
    points = stash(points, "rim")
    rows, cols = max(r for _, r in ends) + 1, max(c for c, _ in ends) + 1
    parts = -(-(-(-rows // tile) * -(-cols // tile)) // _TILES)  # tiles cost time, not bytes, by which tasks would be merged
    by_place = {(r["col"], r["row"]): (r["z"], r["gx"], r["gy"]) for r in points.join(corner, _CELL, "left_semi").collect()}  # the hull's corners
    corners = np.array(ends, np.int64)
    heights = np.array([[np.nan if x is None else x for x in by_place[p]] for p in ends], float)
    size = int(corners.max())
    down = lambda c, by=0: F.floor((F.col(c) + by) / tile).cast("int")

    def seen(halo: int) -> DataFrame:
        near = lambda c: F.sequence(down(c, -halo), down(c, halo))
        return points.withColumn("ti", F.explode(near("row"))).withColumn("tj", F.explode(near("col")))

    def triangulated(todo: DataFrame, given: DataFrame, halo: int) -> DataFrame:
        todo, given = (df.repartition(parts, "ti", "tj").groupBy("ti", "tj") for df in (todo, given))
        return stash(todo.cogroup(given).applyInPandas(_solve(corners, heights, tile, halo, method == "cubic"), _FOUND), "triangulated")

    todo = cells.filter("z IS NULL").select(*_CELL, down("row").alias("ti"), down("col").alias("tj"))
    first = triangulated(todo, seen(halo), halo)
    done, found = first.filter("sure"), first.filter("NOT sure")
    if found.isEmpty():
        return _filled(cells, done)
    known = corner.limit(0).selectExpr("0 AS ti", "0 AS tj", "row", "col")
    outer = points.join(corner, _CELL, "left_anti")  # every tile knows the corners
    todo, halo = found.select(*_CELL, "ti", "tj"), max(halo, tile)
    while True:
        given = seen(halo).join(todo.select("ti", "tj").distinct(), ["ti", "tj"], "left_semi")
        given = given.unionByName(known.join(points, _CELL).select("ti", "tj", *_POINT))
        found = triangulated(todo, given, halo)
        new = stash(_unseen(found, outer, known, tile, halo, size), "unseen")
        if new.isEmpty():
            return _filled(cells, done.unionByName(found))
        again = new.select("ti", "tj").distinct()
        left = found.filter("NOT sure").join(again, ["ti", "tj"], "left_semi")
        done = done.unionByName(found.filter("sure")).unionByName(found.filter("NOT sure").join(again, ["ti", "tj"], "left_anti"))
        todo = left.select(*_CELL, "ti", "tj")
        known = stash(known.unionByName(new), "known")
