"""Union, intersection and difference of sets of polygons as geometry.

A set is a table of edges (poly, x1, y1, x2, y2), in any direction; a polygon is what an odd number of its edges lie to the right of, and the set is
what any of its polygons covers, so a union of one set merges it.

Edges go to square blocks, each only to those it runs through, with whether its polygon holds the place at the middle of the block's left side; that
follows from the polygon's edges in the same band to the left. Blocks that a polygon holds whole without an edge in them are told as runs of a band.
A task takes a block and cuts it in buckets. Of a bucket that one polygon holds whole no edge of that set is on its border, so such buckets drop out, by a table
of polygons and buckets. In the others the ways along each edge on which polygons are entered and left are counted, just left and just
right of it, so a part of an edge is on the border of a result that holds on one side only, and goes with that side on its left. Sides of lines are told exactly, and
both edges of a crossing get the same corner, so the parts form rings (see `rings`) whatever they touch or share. Corners are rounded to `places` decimals, those that are
given before, those of crossings after all sides are told; what then runs both ways between two corners goes. No polygon is ever held by one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegrid.functions.shared import stash
from tidegrid.operators import rings

_EDGE = ["x1", "y1", "x2", "y2"]
_RULES = {
    "union": lambda a, b: a | b,
    "intersection": lambda a, b: a & b,
    "difference": lambda a, b: a & ~b,
    "symmetric": lambda a, b: a != b,
    "a": lambda a, b: a,
    "b": lambda a, b: b,
}
#: Edges of a block where they are spread evenly, pairs of edges worked on at once, and cells of a table of polygons and buckets.
_BLOCK, _PAIRS, _TABLE = 3000, 1 << 20, 1 << 22
_PARTS = "rule string, ex1 double, ey1 double, ex2 double, ey2 double, t0 double, t1 double, x1 double, y1 double, x2 double, y2 double, c0 boolean, c1 boolean, way int"


class _Blocks:
    """Square blocks of about `_BLOCK` edges, not less than the edges' mean length, and how many buckets a side of theirs is: of the mean length, or of down to
    a sixteenth of it where many edges lie over one another. They begin at no round number, so corners and sides of given shapes are not on their sides."""

    def __init__(self, edges: DataFrame):
        long = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
        least, most = [[f(g(f"{c}1", f"{c}2")) for c in "xy"] for f, g in ((F.min, F.least), (F.max, F.greatest))]
        r = edges.agg(F.count("*").alias("n"), F.avg(long).alias("long"), *[v.alias(f"{c}{i}") for i, two in enumerate((least, most)) for c, v in zip("xy", two, strict=True)]).first()  # one row
        n, long = r["n"], r["long"] or 1.0
        area = (r["x1"] - r["x0"] + long) * (r["y1"] - r["y0"] + long) if n else 1.0
        fine = long / min(16, max(1, round(2 * math.sqrt(n * long**2 / area))))
        even = (math.sqrt((1.27 * long) ** 2 + 4 * _BLOCK * area / max(n, 1)) - 1.27 * long) / 2
        self.k = min(64, max(1, round(max(even, long) / fine)))
        self.side = self.k * fine * 1.0137962
        self.x0, self.y0 = (r["x0"] or 0.0) - 0.3819766 * self.side, (r["y0"] or 0.0) - 0.4142136 * self.side

    def down(self, v: Column, axis: str) -> Column:
        return F.floor((v - (self.x0 if axis == "x" else self.y0)) / self.side).cast("long")


def _blocked(edges: DataFrame, blocks: _Blocks) -> DataFrame:
    """`edges` with (bx, by) of every block that each runs through, and `mid`, whether it crosses the middle of the band there."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    pad = blocks.side * 1e-6
    at = edges.withColumn("by", F.explode(F.sequence(blocks.down(low - pad, "y"), blocks.down(high + pad, "y"))))
    # the part of the edge within the band, a little widened
    slope = F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    edge_y = lambda k: blocks.y0 + (F.col("by") + k) * blocks.side
    x_at = lambda y: F.col("x1") + (F.least(F.greatest(y, low), high) - F.col("y1")) * slope
    ends = [F.when(F.col("y1") == F.col("y2"), F.col(c)).otherwise(x_at(y)) for c, y in (("x1", edge_y(0) - pad), ("x2", edge_y(1) + pad))]
    at = at.withColumn("_f", blocks.down(F.least(*ends) - pad, "x")).withColumn("_l", blocks.down(F.greatest(*ends) + pad, "x"))
    middle = edge_y(0.5)
    mid = F.when((F.col("y1") > middle) != (F.col("y2") > middle), F.least(F.greatest(blocks.down(x_at(middle), "x"), F.col("_f")), F.col("_l")))
    at = at.withColumn("mid", mid).withColumn("bx", F.explode(F.sequence("_f", "_l")))
    return at.withColumn("mid", F.coalesce(F.col("mid") == F.col("bx"), F.lit(False)).cast("int")).drop("_f", "_l")


def _covered(sides: DataFrame) -> DataFrame:
    """(set, by, lo, hi): runs of blocks that single polygons hold whole, merged where they meet. `sides`: blocked edges with set and poly. In a band, the blocks
    between two that a polygon's edges run through are all in it or all out of it, by the edges to their left at the band's middle."""
    band = Window.partitionBy("set", "poly", "by").orderBy("bx")
    gaps = sides.select("set", "by", (F.col("bx") + 1).alias("lo"), (F.lead("bx").over(band) - 1).alias("hi"), F.sum("mid").over(band.rangeBetween(Window.unboundedPreceding, 0)).alias("left"))
    gaps = gaps.filter("lo <= hi AND left % 2 = 1").select("set", "by", "lo", "hi").distinct()
    line = Window.partitionBy("set", "by").orderBy("lo", "hi")
    before = F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1))
    runs = gaps.withColumn("new", F.coalesce(F.col("lo") > before + 1, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("set", "by", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def _beside(blocks: DataFrame, runs: DataFrame) -> DataFrame:
    """(set, by, bx): those of `blocks` (by, bx) that one of a set's `runs` (set, by, lo, hi), which do not meet, holds."""
    ends = blocks.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("set"), "by", "bx", F.lit(None).cast("long").alias("hi"), F.lit(1).alias("kind"))
    both = ends.unionByName(runs.select("set", "by", F.col("lo").alias("bx"), "hi", F.lit(0).alias("kind")))
    order = Window.partitionBy("set", "by").orderBy("bx", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("end", F.last("hi", True).over(order)).filter("kind = 1 AND end >= bx").select("set", "by", "bx")


def _side(ax, ay, bx, by, px, py) -> np.ndarray:
    """1, 0 or -1: whether points p lie to the left of lines from a to b, on them, or to the right. Exact."""
    dx, dy, qx, qy = bx - ax, by - ay, px - ax, py - ay
    left, right = dx * qy, dy * qx
    out = np.sign(left - right)
    end = (px == bx) & (py == by)
    out[end] = 0
    # a product is nought only where a factor is, and differences have their right sign
    for i in np.flatnonzero((np.abs(left - right) <= 4e-16 * (np.abs(left) + np.abs(right))) & (left != 0) & ~end):
        a, b, c, d, e, f = (Fraction(float(v[i])) for v in (ax, ay, bx, by, px, py))
        v = (c - a) * (f - b) - (d - b) * (e - a)
        out[i] = (v > 0) - (v < 0)
    return out


def _corner(v: np.ndarray) -> np.ndarray:
    """Rounded, but not from the half on, where corners of given shapes may lie: crossings of several edges at one place must go to one corner."""
    return np.floor(v + 0.6180339887)


def _cross(ax, ay, bx, by):
    return ax * by - ay * bx


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, v) of v from first[i] on, count[i] of them."""
    i = np.repeat(np.arange(len(count)), count)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + first[i]


def _through(e: np.ndarray, box) -> tuple[np.ndarray, ...]:
    """(t, u, s, v): where lines through the edges e (n, 4) enter and leave boxes (w, e, s, n), as parts of the edges from their first ends on, and the way to there along
    the box's sides, against the clock from the middle of its left side on; the four sides are 4. t >= u where they miss the box. Edges begin at their lesser ends."""
    x, y, dx, dy = e[:, 0], e[:, 1], e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    w, east, south, n = box
    with np.errstate(divide="ignore", invalid="ignore"):
        tx, ux, ta, ua = (w - x) / dx, (east - x) / dx, (south - y) / dy, (n - y) / dy
        up = dy >= 0
        ty, uy = np.where(up, ta, ua), np.where(up, ua, ta)
        t, u = np.maximum(tx, ty), np.minimum(ux, uy)
        wide, high = east - w, n - south
        at, middle = y + t * dy, (south + n) / 2
        west = np.where(at <= middle, (middle - at) / high, 3.5 + (n - at) / high)
        level = lambda t, low: np.where(low, 0.5 + (x + t * dx - w) / wide, 2.5 + (east - x - t * dx) / wide)
        s = np.where(tx >= ty, west, level(t, up))
        v = np.where(ux <= uy, 1.5 + (y + u * dy - south) / high, level(u, ~up))
    return t, u, s, v


def _spans(e: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket): the buckets, by line and place in it, that edges run through, a little widened."""
    k, d = len(xs) - 1, xs[1] - xs[0]
    pad = 1e-6 * d
    x, y, dx, dy = e[:, 0], e[:, 1], e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]

    def within(row, low, high, start, step):
        """The part of each edge between low and high."""
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = (low - start[row]) / step[row], (high - start[row]) / step[row]
        flat = step[row] == 0
        inside = (start[row] >= low) & (start[row] <= high)
        return np.where(flat, np.where(inside, 0.0, 2.0), np.minimum(a, b)), np.where(flat, 1.0, np.maximum(a, b))

    every = np.arange(len(e))
    t0, t1 = within(every, xs[0] - pad, xs[-1] + pad, x, dx)
    t0, t1 = np.maximum(t0, 0), np.minimum(t1, 1)
    every = np.flatnonzero(t0 <= t1)
    at = y[every] + t0[every] * dy[every], y[every] + t1[every] * dy[every]
    place = lambda v, zero: np.clip(np.floor((v - zero) / d), -1, k).astype(np.int64)
    first = np.maximum(place(np.minimum(*at) - pad, ys[0]), 0)
    last = np.minimum(place(np.maximum(*at) + pad, ys[0]), k - 1)
    i, j = _ranges(first, np.maximum(last - first + 1, 0))
    row = every[i]
    a, b = within(row, ys[j] - pad, ys[j + 1] + pad, y, dy)
    a, b = np.maximum(a, t0[row]), np.minimum(b, t1[row])
    ok = a <= b
    row, j, a, b = row[ok], j[ok], a[ok], b[ok]
    first = np.maximum(place(x[row] + a * dx[row] - pad, xs[0]), 0)
    last = np.minimum(place(x[row] + b * dx[row] + pad, xs[0]), k - 1)
    i, c = _ranges(first, np.maximum(last - first + 1, 0))
    return row[i], j[i] * k + c


def _holds(e, poly, left, row, bucket, xs, ys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, inside, whole): for every polygon and bucket with edges in it (poly * buckets + bucket, sorted) whether the middle of the bucket's left side is inside; and which buckets
    any polygon without edges there holds. `poly` is sorted; left[p]: whether p holds the middle of the block's left side."""
    k = len(xs) - 1
    n, middle, heights = k * k, (ys[0] + ys[-1]) / 2, (ys[:-1] + ys[1:]) / 2
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    keys, insides, whole = [], [], np.zeros(n, bool)
    step = max(1, _TABLE // n)
    order = np.argsort(poly[row], kind="stable")
    row, bucket = row[order], bucket[order]
    for p in range(0, len(left), step):
        m = min(step, len(left) - p)
        r0, r1 = np.searchsorted(poly, [p, p + m])
        mine = np.arange(r0, r1)
        # up and down the block's left side, from its middle
        turn = np.zeros((m, k + 1), np.int64)
        turn[:, 0] = left[p : p + m]
        r = mine[(e[mine, 0] > xs[0]) != (e[mine, 2] > xs[0])]
        at = e[r, 1] + (xs[0] - e[r, 0]) * (dy[r] / dx[r])
        j = np.searchsorted(heights, at, "right")
        np.add.at(turn, (poly[r] - p, j), 1)
        np.add.at(turn, (poly[r[at < middle]] - p, 0), 1)
        start = np.cumsum(turn[:, :k], axis=1)
        # from there along the middles of the buckets
        low, high = np.minimum(e[mine, 1], e[mine, 3]), np.maximum(e[mine, 1], e[mine, 3])
        first = np.searchsorted(heights, low, "left")
        i, j = _ranges(first, np.maximum(np.searchsorted(heights, high, "left") - first, 0))
        r = mine[i]
        at = e[r, 0] + (heights[j] - e[r, 1]) * (dx[r] / dy[r])
        ok = at > xs[0]
        flat = ((poly[r] - p) * k + j) * (k + 1) + np.searchsorted(xs, at, "left")
        flips = np.bincount(flat[ok & (at < xs[-1])], minlength=m * k * (k + 1)).reshape(m, k, k + 1)[:, :, :k]
        inside = ((np.cumsum(flips, axis=2) + start[:, :, None]) & 1).astype(bool).reshape(m, n)
        i0, i1 = np.searchsorted(poly[row], [p, p + m])
        touched = np.zeros((m, n), bool)
        touched[poly[row[i0:i1]] - p, bucket[i0:i1]] = True
        whole |= (inside & ~touched).any(axis=0)
        found = np.flatnonzero(touched)
        keys.append(found + p * n)
        insides.append(inside.reshape(-1)[found])
    return np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*insides, np.zeros(0, bool)]), whole


def _meet(e, f, on_e1, on_e2) -> np.ndarray:
    """Where lines through edges f cross edges e, as parts of e; `on_e1`, `on_e2`: the sides of f that e's ends are on, which decide whether that is within e."""
    de, df = (e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]), (f[:, 2] - f[:, 0], f[:, 3] - f[:, 1])
    size = _cross(*de, *df)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = _cross(f[:, 0] - e[:, 0], f[:, 1] - e[:, 1], *df) / size
    # at a sharp angle digits are lost
    for i in np.flatnonzero(np.abs(size) <= 1e-3 * np.hypot(*de) * np.hypot(*df)):
        a, b, c, d, p, q, r, s = (Fraction(float(v)) for v in (*e[i], *f[i]))
        t[i] = float(Fraction((p - a) * (s - q) - (q - b) * (r - p), (c - a) * (s - q) - (d - b) * (r - p)))
    out = on_e1 * on_e2 > 0
    t = np.where(out & (t >= 0) & (t <= 1), np.where(t < 0.5, -1e-300, 1 + 1e-15), t)
    t = np.where(on_e1 * on_e2 < 0, np.clip(t, 1e-300, 1 - 1e-16), t)
    return np.where(on_e1 == 0, 0.0, np.where(on_e2 == 0, 1.0, t))


class _Line:
    """Events along candidate edges in their buckets: places where a polygon is entered or left, just right or just left of the edge."""

    def __init__(self, n: int):
        self.start = np.zeros((n, 5), np.int64)  # of both sets right, of both left, and lesser edges on the same line
        self.rows: list[tuple] = []

    def add(self, c, t, x, y, column, change) -> None:
        self.rows.append((c, t, x, y, column, change))


def _parts(rule, e, poly, of_b, row, bucket, key, inside, whole, touched, xs, ys) -> tuple | None:
    """Parts of the edges of a block that are on the border of `rule`, in order and joined: (edge, t0, t1, x1, y1, x2, y2, c0, c1, way)."""
    k = len(xs) - 1
    value = lambda a, b: bool(rule(np.bool_(a), np.bool_(b)))
    can = [[~whole[s], whole[s] | touched[s]] for s in (0, 1)]
    counts = np.zeros((2, k * k), bool)  # where the result depends on a set that is open
    for other in (0, 1):
        counts[0] |= can[1][other] if value(0, other) != value(1, other) else False
        counts[1] |= can[0][other] if value(other, 0) != value(other, 1) else False
    counts &= touched & ~whole
    # there all edges are told, as one may lie on another of the other set
    ok = counts.any(axis=0)[bucket]
    if not ok.any():
        return None
    row, bucket = row[ok], bucket[ok]
    order = np.lexsort((poly[row], bucket))
    row, bucket = row[order], bucket[order]
    # the others in each bucket, by polygon
    ends, g_of_row = np.unique(e, axis=0, return_inverse=True)
    g_of_row = g_of_row.reshape(-1)
    box = lambda b: (xs[b % k], xs[b % k + 1], ys[b // k], ys[b // k + 1])
    f, fg = e[row], g_of_row[row]
    t, u, s, v = _through(f, box(bucket))
    real = t < u
    f_in, f_out = np.where(real & (t > 0) & (t < 1), s, np.inf), np.where(real & (u > 0) & (u < 1), v, np.inf)
    new = np.r_[True, (bucket[1:] != bucket[:-1]) | (poly[row[1:]] != poly[row[:-1]])]
    group = np.cumsum(new) - 1
    held = inside[np.searchsorted(key, poly[row[new]] * (k * k) + bucket[new])]
    set_of = of_b[poly[row[new]]].astype(np.int64)
    # the edges to be told, each once in a bucket
    c_key = np.unique(bucket * len(ends) + fg)
    cb, cg = c_key // len(ends), c_key % len(ends)
    ce = ends[cg]
    ct, cu, cs, _ = _through(ce, box(cb))
    ok = np.maximum(ct, 0) < np.minimum(cu, 1)
    cb, cg, ce, ct, cu, cs = cb[ok], cg[ok], ce[ok], ct[ok], cu[ok], cs[ok]
    o0, o1 = np.searchsorted(bucket, cb, "left"), np.searchsorted(bucket, cb, "right")
    line = _Line(len(cb))
    bounds, total = [0], np.cumsum(o1 - o0)
    while bounds[-1] < len(cb):
        before = total[bounds[-1] - 1] if bounds[-1] else 0
        bounds.append(max(bounds[-1] + 1, int(np.searchsorted(total, before + _PAIRS, "right"))))
    for c0, c1 in zip(bounds, bounds[1:], strict=False):
        i, o = _ranges(o0[c0:c1], (o1 - o0)[c0:c1])
        _count(line, i + c0, o, ce, cg, ct, cu, cs, f, fg, f_in, f_out, group, held, set_of)
    return _told(rule, line, counts[:, cb], whole[:, cb], ce, cg, ct, cu)


def _count(line: _Line, c, o, ce, cg, ct, cu, cs, f, fg, f_in, f_out, group, held, set_of) -> None:
    """Pairs of edges c and others o of their buckets, by polygon: what is around each edge where it comes into its bucket, and what changes along it."""
    e = ce[c].T
    at = f[o].T
    s1, s2 = _side(*e, at[0], at[1]), _side(*e, at[2], at[3])
    same = (s1 == 0) & (s2 == 0)
    new = np.r_[True, (c[1:] != c[:-1]) | (group[o[1:]] != group[o[:-1]])]
    first, pg = np.flatnonzero(new), np.cumsum(new) - 1
    gc, gs, gh = c[first], set_of[group[o[first]]], held[group[o[first]]].astype(np.int64)
    begin, out = f_in[o], f_out[o] < cs[c]
    for side, cuts, before in ((0, (s1 >= 0) != (s2 >= 0), np.where(same, np.isfinite(begin), begin < cs[c])), (2, (s1 > 0) != (s2 > 0), ~same & (begin < cs[c]))):
        now = (gh + np.add.reduceat(before.astype(np.int64) + out, first)) & 1
        np.add.at(line.start, (gc, gs + side), now)
        p = np.flatnonzero(cuts)
        if not len(p):
            continue
        ep, fp = ce[c[p]], f[o[p]]
        on1, on2 = _side(*fp.T, ep[:, 0], ep[:, 1]), _side(*fp.T, ep[:, 2], ep[:, 3])
        t = _meet(ep, fp, on1, on2)
        ok = (t > ct[c[p]]) & (t <= cu[c[p]])
        p, ep, fp, on1, on2, t = p[ok], ep[ok], fp[ok], on1[ok], on2[ok], t[ok]
        # worked out once, from the lesser edge, so both get the same corner
        u = _meet(fp, ep, s1[p], s2[p])
        lesser = cg[c[p]] < fg[o[p]]
        by = np.where(lesser[:, None], ep, fp)
        far = np.where(lesser, t, u)
        x, y = (_corner(by[:, i] + far * (by[:, i + 2] - by[:, i])) for i in (0, 1))
        for on, end, i in ((on2, ep, 2), (on1, ep, 0), (s2[p], fp, 2), (s1[p], fp, 0)):
            x, y = np.where(on == 0, end[:, i], x), np.where(on == 0, end[:, i + 1], y)
        order = np.lexsort((t, pg[p]))
        p, t, x, y = p[order], t[order], x[order], y[order]
        begins = np.r_[True, pg[p[1:]] != pg[p[:-1]]] if len(p) else np.zeros(0, bool)
        rank = np.arange(len(p)) - np.maximum.accumulate(np.where(begins, np.arange(len(p)), 0)) if len(p) else np.arange(0)
        line.add(c[p], t, x, y, set_of[group[o[p]]] + side, 1 - 2 * ((now[pg[p]] + rank) & 1))
    # of edges along one line only the least counts where they lie over one another
    p = np.flatnonzero(same & (fg[o] < cg[c]))
    ep, fp = ce[c[p]], f[o[p]]
    dx, dy = ep[:, 2] - ep[:, 0], ep[:, 3] - ep[:, 1]
    t0, t1 = (((fp[:, i] - ep[:, 0]) * dx + (fp[:, i + 1] - ep[:, 1]) * dy) / (dx * dx + dy * dy) for i in (0, 2))
    np.add.at(line.start, (c[p], 4), ((t0 <= ct[c[p]]) & (t1 > ct[c[p]])).astype(np.int64))
    for t, i, change in ((t0, 0, 1), (t1, 2, -1)):
        ok = (t > ct[c[p]]) & (t <= cu[c[p]])
        line.add(c[p][ok], t[ok], fp[ok, i], fp[ok, i + 1], np.full(ok.sum(), 4), np.full(ok.sum(), change))


def _told(rule, line: _Line, counts, whole, ce, cg, ct, cu) -> tuple | None:
    """The parts of the edges that are on the border, from what changes along them."""
    n = len(cg)
    every = np.arange(n)
    c, t, x, y, column, change = (np.concatenate([r[i] for r in line.rows] or [np.zeros(0)]) for i in range(6))
    c, t, x, y = np.r_[every, c].astype(np.int64), np.r_[np.full(n, -np.inf), t], np.r_[ce[:, 0], x], np.r_[ce[:, 1], y]
    order = np.lexsort((t, c))
    deltas = np.zeros((len(c), 5), np.int64)
    deltas[:n] = line.start
    deltas[np.arange(n, len(c)), column.astype(np.int64)] = change
    c, t, x, y, deltas = c[order], t[order], x[order], y[order], deltas[order]
    first = np.searchsorted(c, every)
    depth = np.cumsum(deltas, axis=0)
    depth -= (depth[first] - deltas[first])[c]
    state = [np.where(counts[i % 2][c], depth[:, i] > 0, whole[i % 2][c]) for i in range(4)]
    right, left = rule(state[0], state[1]), rule(state[2], state[3])
    low, high = np.maximum(ct, 0)[c], np.minimum(cu, 1)[c]
    last = np.r_[c[1:] != c[:-1], True]
    after, ax, ay = np.where(last, np.inf, np.r_[t[1:], 0]), np.r_[x[1:], 0], np.r_[y[1:], 0]
    t0, t1 = np.maximum(t, low), np.minimum(after, high)
    keep = (right != left) & (depth[:, 4] == 0) & (t0 < t1)
    if not keep.any():
        return None
    c, t, x, y, after, ax, ay, low, high, t0, t1 = (v[keep] for v in (c, t, x, y, after, ax, ay, low, high, t0, t1))
    e = ce[c]
    cut = lambda t, i: _corner(e[:, i] + t * (e[:, i + 2] - e[:, i]))
    begun, ended = (t <= low) & (low > 0), (after > high) & (high < 1)
    px, py = (np.where(t > low, v, np.where(low > 0, cut(low, i), e[:, i])) for i, v in ((0, x), (1, y)))
    qx, qy = (np.where(after <= high, v, np.where(high < 1, cut(high, i), e[:, i + 2])) for i, v in ((0, ax), (1, ay)))
    way = np.where(left[keep], 1, -1)
    order = np.lexsort((t0, cg[c]))
    g, t0, t1, px, py, qx, qy, begun, ended, way = (v[order] for v in (cg[c], t0, t1, px, py, qx, qy, begun, ended, way))
    new = np.r_[True, (g[1:] != g[:-1]) | (t0[1:] != t1[:-1]) | (way[1:] != way[:-1])]
    end = np.r_[new[1:], True]
    return e[order][new], t0[new], t1[end], px[new], py[new], qx[end], qy[end], begun[new], ended[end], way[new]


def _block(rules: Sequence[str], blocks: _Blocks, places: int) -> Callable:
    # whole numbers of the last place, so that what lies on one line in decimals does
    unit = 10.0**places
    x0, y0, side, k = blocks.x0 * unit, blocks.y0 * unit, blocks.side * unit, blocks.k

    def run(at: tuple, table: pa.Table) -> pa.Table:
        schema = pa.schema([("rule", pa.string()), *[(c, pa.float64()) for c in ("ex1", "ey1", "ex2", "ey2", "t0", "t1", *_EDGE)], ("c0", pa.bool_()), ("c1", pa.bool_()), ("way", pa.int32())])
        by, bx = (v.as_py() for v in at)
        marks = table["poly"].is_null().to_numpy()
        sets = table["set"].to_numpy()
        rows = table.filter(pa.array(~marks))
        if not len(rows):
            return schema.empty_table()
        # by set and polygon
        order = np.lexsort((rows["poly"].to_numpy(), rows["set"].to_numpy()))
        of, name = rows["set"].to_numpy()[order], rows["poly"].to_numpy()[order]
        e = np.rint(np.column_stack([rows[c].to_numpy() for c in _EDGE])[order] * unit) + 0.0
        new = np.r_[True, (of[1:] != of[:-1]) | (name[1:] != name[:-1])]
        poly, of_b, left = np.cumsum(new) - 1, of[new] == 1, rows["inside"].to_numpy()[order][new]
        fine = k * min(4, max(1, round(math.sqrt(len(e) / (8 * _BLOCK)))))
        xs, ys = (zero + (b + np.arange(fine + 1) / fine) * side for zero, b in ((x0, bx), (y0, by)))
        xs[-1], ys[-1] = x0 + (bx + 1) * side, y0 + (by + 1) * side
        row, bucket = _spans(e, xs, ys)
        keys, insides, whole, touched = [], [], np.zeros((2, fine * fine), bool), np.zeros((2, fine * fine), bool)
        for s in (0, 1):
            whole[s] = bool((marks & (sets == s)).any())
            p0, p1 = np.searchsorted(of_b, [s, s + 1])
            mine, own = np.flatnonzero(of_b[poly] == s), of_b[poly[row]] == s
            touched[s, bucket[own]] = True
            zero = mine[0] if len(mine) else 0
            key, inside, held = _holds(e[mine], poly[mine] - p0, left[p0:p1], row[own] - zero, bucket[own], xs, ys)
            keys.append(key + p0 * fine * fine)
            insides.append(inside)
            whole[s] |= held
        out = []
        for rule in rules:
            found = _parts(_RULES[rule], e, poly, of_b, row, bucket, np.concatenate(keys), np.concatenate(insides), whole, touched, xs, ys)
            if found is not None:
                edge, t0, t1, *corners, c0, c1, way = found
                arrays = [[rule] * len(edge), *(edge / unit + 0.0).T, t0, t1, *[v / unit + 0.0 for v in corners], c0, c1, way]
                out.append(pa.table([pa.array(v, f.type) for v, f in zip(arrays, schema, strict=True)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def overlays(a: DataFrame, b: DataFrame, rules: Sequence[str], places: int = 9) -> DataFrame:
    """(rule, id, x1, y1, x2, y2): the borders of a set of polygons joined with another by each of `rules` (union, intersection, difference, symmetric, or a and b for one
    set alone), the inside on the left. Each is found for itself. An empty set covers nothing."""
    if unknown := set(rules) - set(_RULES):
        raise ValueError(f"no rule {', '.join(sorted(unknown))}")
    ends = [(F.round(F.col(c).cast("double"), places) + 0.0).alias(c) for c in _EDGE]
    sets = [s.select(F.lit(i).alias("set"), (F.col("poly").cast("long") if dict(s.dtypes)["poly"] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("poly")).alias("poly"), *ends) for i, s in enumerate((a, b))]
    edges = sets[0].unionByName(sets[1]).filter("x1 <> x2 OR y1 <> y2")
    swap = F.struct("x1", "y1") > F.struct("x2", "y2")
    edges = stash(edges.select("set", "poly", *[F.when(swap, F.col(q)).otherwise(F.col(p)).alias(p) for p, q in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]), "edges")
    blocks = _Blocks(edges)
    sides = _blocked(edges, blocks)
    runs = stash(_covered(sides), "covered")
    before = Window.partitionBy("set", "poly", "by").orderBy("bx").rangeBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("mid").over(before), F.lit(0)) % 2 == 1
    placed = sides.select("set", "poly", "by", "bx", *_EDGE, inside.alias("inside"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("poly", "long"), *[(c, "double") for c in _EDGE], ("inside", "boolean"))]
    placed = placed.unionByName(_beside(sides.select("by", "bx").distinct(), runs).select("set", "by", "bx", *none))
    found = stash(placed.groupBy("by", "bx").applyInArrow(_block(list(rules), blocks, places), _PARTS), "parts")
    # what runs on beyond its block is joined
    line = ["rule", "ex1", "ey1", "ex2", "ey2"]
    order = Window.partitionBy(*line).orderBy("t0")
    on = F.col("c0") & (F.lag("t1").over(order) == F.col("t0")) & (F.lag("way").over(order) == F.col("way"))
    cut = found.filter("c0 OR c1").withColumn("new", (~F.coalesce(on, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(order))
    ends = [*[F.min_by(c, "t0").alias(c) for c in ("x1", "y1")], *[F.max_by(c, "t0").alias(c) for c in ("x2", "y2")]]
    cut = cut.groupBy(*line, "run").agg(*ends, F.first("way").alias("way"))
    whole = found.filter("NOT c0 AND NOT c1").select("rule", *_EDGE, "way").unionByName(cut.select("rule", *_EDGE, "way")).filter("x1 <> x2 OR y1 <> y2")
    turned = F.struct("x1", "y1") > F.struct("x2", "y2")
    swapped = [F.when(turned, F.col(q)).otherwise(F.col(p)).alias(p) for p, q in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    net = whole.select("rule", *swapped, F.when(turned, -F.col("way")).otherwise(F.col("way")).alias("way")).groupBy("rule", *_EDGE).agg(F.sum("way").alias("way")).filter("way <> 0")
    turned = [F.when(F.col("way") > 0, F.col(p)).otherwise(F.col(q)).alias(p) for p, q in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    return stash(net.select("rule", F.xxhash64(*_EDGE).alias("id"), *turned), "pieces")


def overlay(a: DataFrame, b: DataFrame, rule: str = "union", places: int = 9) -> DataFrame:
    """(id, x1, y1, x2, y2): the border of a set of polygons joined with another by `rule` (union, intersection, difference, symmetric), the inside on the left.
    An empty set covers nothing."""
    return overlays(a, b, [rule], places).drop("rule")


def overlay_polygons(a: DataFrame, b: DataFrame, rule: str = "union", places: int = 9) -> DataFrame:
    """(shell, wkt, area, holes): the polygons of `overlay`, a row for each shell."""
    edges = stash(rings.link(overlay(a, b, rule, places)), "ringed")
    return rings.wkt(edges, rings.nest(edges))


def area(edges: DataFrame) -> DataFrame:
    """(area): what the border of a set encloses."""
    return edges.agg((F.coalesce(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")), F.lit(0.0)) / 2).alias("area"))


def areas(borders: DataFrame) -> DataFrame:
    """One row with a column for each rule: what that border of `overlays` encloses; 0 where there is none."""
    twice = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return borders.agg(*[(F.coalesce(F.sum(F.when(F.col("rule") == r, twice)), F.lit(0.0)) / 2).alias(r) for r in _RULES])
