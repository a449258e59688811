"""Splines in tension: the smoothest surface through all cells with data.

The surface minimises (1 - tension) * (zxx**2 + 2 * zxy**2 + zyy**2) + tension * (zx**2 + zy**2), summed over all differences that lie in the grid, with
cells that have data kept as they are; so its edges are free. Tension 0 is a thin plate, 1 a membrane.

It is found from coarse to fine. A grid no larger than a tile is solved at once; each finer one, of twice as many cells a line, begins with the coarser surface by
cubic convolution, in the first round itself. Tiles are solved by conjugate gradients, each with a halo, with what lies around as it was, and keep their own cells; in
rounds, each a written table, until no cell moves by more than `convergence` times the data's range. A row of these tables is what a line of the grid has within a tile, and a
tile is sent no more of its neighbours' lines than its halo. No task holds more than a tile with its halo.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidegrid.functions.shared import stash
from tidegrid.operators.rasters import decimate

_CELL = ["row", "col"]
#: Cells beyond a halo that the differences of its cells reach.
_RING = 2
#: Cells beyond which no cell of a grid half as fine has weight in a cubic convolution.
_SPAN = 4


def bending(z: np.ndarray, tension: float) -> np.ndarray:
    """Half the gradient of the energy of a grid: a linear function of z."""
    out = np.zeros_like(z)
    for stiff, flip in ((1 - tension, False), (1 - tension, True)):
        v, o = (z.T, out.T) if flip else (z, out)
        if v.shape[1] > 2:
            d = stiff * (v[:, :-2] - 2 * v[:, 1:-1] + v[:, 2:])
            o[:, :-2] += d
            o[:, 1:-1] -= 2 * d
            o[:, 2:] += d
        if v.shape[1] > 1:
            d = tension * (v[:, 1:] - v[:, :-1])
            o[:, 1:] += d
            o[:, :-1] -= d
    d = 2 * (1 - tension) * (z[:-1, :-1] - z[:-1, 1:] - z[1:, :-1] + z[1:, 1:])
    for rows, cols, sign in ((slice(-1), slice(-1), 1), (slice(-1), slice(1, None), -1), (slice(1, None), slice(-1), -1), (slice(1, None), slice(1, None), 1)):
        out[rows, cols] += sign * d
    return out


def relax(z: np.ndarray, free: np.ndarray, tension: float, most: int = 4000, close: float = 1e-9) -> np.ndarray:
    """`z` with the free cells where the energy is least, the others kept: conjugate gradients from z on."""
    z = z.copy()
    r = np.where(free, -bending(z, tension), 0.0)
    p, rr = r.copy(), float((r * r).sum())
    end = rr * close**2
    for _ in range(most):
        if rr <= end or rr < 1e-280:
            break
        q = np.where(free, bending(p, tension), 0.0)
        curve = float((p * q).sum())
        if curve <= 0:
            break
        step = rr / curve
        z += step * p
        r -= step * q
        new = float((r * r).sum())
        p, rr = r + new / rr * p, new
    return z


def _seen(t: int, tile: int, reach: int, n: int, k: int = 1) -> tuple[int, int]:
    """The first of n lines that tile t sees, and the one after the last; of a grid k times as coarse as the tile's."""
    return max(0, -((reach - t * tile) // k)), min(n, -(-((t + 1) * tile + reach) // k))


def _cubic(fine: tuple[int, int], coarse: tuple[int, int]) -> np.ndarray:
    """Weights (fine lines, coarse lines) of the cubic convolution of a grid half as fine; beside its edges the weights of the lines that exist are renewed to sum to 1."""
    t = np.abs((np.arange(*fine)[:, None] + 0.5) / 2 - 0.5 - np.arange(*coarse))
    w = np.where(t <= 1, (t * 1.5 - 2.5) * t * t + 1, np.where(t < 2, ((t * -0.5 + 2.5) * t - 4) * t + 2, 0.0))
    return w / w.sum(axis=1, keepdims=True)


def _placed(segments: pd.DataFrame, name: str, out: np.ndarray, r0: int, c0: int) -> np.ndarray:
    """`out`, whose first cell is (r0, c0), with the values of the segments."""
    for r, c, v in zip(segments["row"], segments["at"], segments[name], strict=True):
        out[r - r0, c - c0 : c - c0 + len(v)] = v
    return out


def _relaxed(key: tuple, z: np.ndarray, fixed: np.ndarray, tile: int, reach: int, rows: int, cols: int, tension: float) -> pd.DataFrame:
    """The tile's own segments, after a round over all that it sees."""
    (ti, tj), free = key, ~fixed
    (r0, r1), (c0, c1) = _seen(ti, tile, reach, rows), _seen(tj, tile, reach, cols)
    # the outermost cells hold still, but at the edges of the grid
    for a, b, low, n in ((r0, r1, 0, rows), (c0, c1, 1, cols)):
        f = free if low == 0 else free.T
        if a > 0:
            f[:_RING] = False
        if b < n:
            f[-_RING:] = False
    new = relax(z, free, tension)
    own = (slice(ti * tile - r0, min((ti + 1) * tile, rows) - r0), slice(tj * tile - c0, min((tj + 1) * tile, cols) - c0))
    lines = np.arange(own[0].start, own[0].stop) + r0
    return pd.DataFrame({"row": lines, "tj": tj, "z": list(new[own]), "fixed": list(fixed[own]), "change": np.abs(new[own] - z[own]).max(axis=1)})


_SEGMENTS = "row int, tj int, z array<double>, fixed array<boolean>, change double"


def _first(tile: int, reach: int, rows: int, cols: int, tension: float, mean: float):
    """A function of a tile's data (row, col, z) and of the coarser surface's segments, if any, to its own segments."""

    def run(key: tuple, data: pd.DataFrame, coarse: pd.DataFrame) -> pd.DataFrame:
        (r0, r1), (c0, c1) = _seen(key[0], tile, reach, rows), _seen(key[1], tile, reach, cols)
        z = np.full((r1 - r0, c1 - c0), mean)
        if len(coarse):
            a, b = (_seen(t, tile, reach + _SPAN, -(-n // 2), 2) for t, n in zip(key, (rows, cols), strict=True))
            seen = _placed(coarse, "z", np.zeros((a[1] - a[0], b[1] - b[0])), a[0], b[0])
            z = _cubic((r0, r1), a) @ seen @ _cubic((c0, c1), b).T
        fixed = np.zeros(z.shape, bool)
        at = (data["row"].to_numpy() - r0, data["col"].to_numpy() - c0)
        z[at], fixed[at] = data["z"].to_numpy(), True
        return _relaxed(key, z, fixed, tile, reach, rows, cols, tension)

    return run


def _next(tile: int, reach: int, rows: int, cols: int, tension: float):
    """A function of all segments that a tile sees to its own."""

    def run(key: tuple, segments: pd.DataFrame) -> pd.DataFrame:
        (r0, r1), (c0, c1) = _seen(key[0], tile, reach, rows), _seen(key[1], tile, reach, cols)
        z, fixed = (_placed(segments, name, np.zeros((r1 - r0, c1 - c0), kind), r0, c0) for name, kind in (("z", float), ("fixed", bool)))
        return _relaxed(key, z, fixed, tile, reach, rows, cols, tension)

    return run


def _tiles(first: Column, last: Column, tile: int, reach: int, n: int) -> Column:
    """The tiles of a line of n cells that see any of the cells from first to last."""
    low, high = F.greatest(F.floor((first - reach) / tile), F.lit(0)), F.least(F.floor((last + reach) / tile), F.lit((n - 1) // tile))
    return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))


def _dealt(segments: DataFrame, tile: int, reach: int, rows: int, cols: int, k: int = 1) -> DataFrame:
    """(ti, tj, row, at, z, fixed): segments, or what is seen of them from column `at` on, for each tile of a grid of rows by cols that is k times as fine."""
    start, size = F.col("tj") * tile, F.size("z")
    shared = segments.select(
        F.explode(_tiles(F.col("row") * k, F.col("row") * k, tile, reach, rows)).alias("ti"), "row", start.alias("_start"), "z", "fixed", _tiles(start * k, (start + size - 1) * k, tile, reach, cols).alias("_tj")
    ).withColumn("tj", F.explode("_tj"))
    low = F.greatest(F.col("_start"), F.ceil((F.col("tj") * tile - reach) / k).cast("int"))
    high = F.least(F.col("_start") + size, F.ceil(((F.col("tj") + 1) * tile + reach) / k).cast("int"))
    part = lambda c: F.slice(c, F.col("_low") - F.col("_start") + 1, F.col("_high") - F.col("_low")).alias(c)
    return shared.withColumn("_low", low).withColumn("_high", high).filter("_high > _low").select("ti", "tj", "row", F.col("_low").alias("at"), part("z"), part("fixed"))


def _rounds(data: DataFrame, coarse: DataFrame | None, rows: int, cols: int, limit: float, tension: float, tile: int, halo: int, most: int, mean: float) -> DataFrame:
    """Segments (row, tj, z, fixed, change) after rounds of tiles: a segment is what a line of the grid has within a tile."""
    reach = halo + _RING
    seen = data.select(F.explode(_tiles(F.col("row"), F.col("row"), tile, reach, rows)).alias("ti"), *_CELL, "z").withColumn("tj", F.explode(_tiles(F.col("col"), F.col("col"), tile, reach, cols)))
    if coarse is None:
        before = data.sparkSession.createDataFrame([], "ti int, tj int, row int, at int, z array<double>")
    else:
        before = _dealt(coarse, tile, reach + _SPAN, rows, cols, 2).drop("fixed")
    # a tile is few bytes and much work: tasks have eight tiles each, more where the shuffle's partitions are fewer, but not above 128
    tiles = -(-rows // tile) * -(-cols // tile)
    parts = max(1, min(-(-tiles // 8), int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))), tiles // 128)
    by = lambda df: df.repartition(parts, "ti", "tj").groupBy("ti", "tj")
    now = by(seen).cogroup(by(before)).applyInPandas(_first(tile, reach, rows, cols, tension, mean), _SEGMENTS)
    for left in range(most - 1, -1, -1):
        now = stash(now, "spline")
        if not left or (rows <= tile and cols <= tile) or now.agg(F.max("change")).first()[0] <= limit:
            break
        now = by(_dealt(now, tile, reach, rows, cols)).applyInPandas(_next(tile, reach, rows, cols, tension), _SEGMENTS)
    return now


def interp_spline(cells: DataFrame, tension: float = 0.35, convergence: float = 1e-4, tile: int = 64, halo: int = 16, most: int = 50) -> DataFrame:
    """(row, col, z) of a whole grid, numbered from 0, with every void filled; cells with data keep their value. `most` rounds of each level at most. Without any data the
    cells come back as they are."""
    cells = cells.select(*_CELL, "z")
    shape = cells.agg(F.max("row"), F.max("col"), F.min("z"), F.max("z"), F.avg("z")).first()
    if shape is None or shape[2] is None:
        return cells
    rows, cols, spread, mean = shape[0] + 1, shape[1] + 1, shape[3] - shape[2], shape[4]
    k = 1
    while max(-(-rows // k), -(-cols // k)) > tile:
        k *= 2
    data, surface = cells.filter("z IS NOT NULL"), None
    while k:
        level = data if k == 1 else decimate(data, k)
        surface = _rounds(level, surface, -(-rows // k), -(-cols // k), convergence * spread, tension, tile, halo, most, float(mean))
        k //= 2
    return surface.select("row", "tj", F.posexplode("z").alias("_at", "z")).select("row", (F.col("tj") * tile + F.col("_at")).alias("col"), "z")
