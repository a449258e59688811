"""Splines against a dense solution, cubic convolution, quadrants, mosaics and manifests."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.grid import GridSpec, Region
from tidegrid.operators import filters, rasters, splines, surfaces
from tidegrid.sources import manifest


def table(spark, z):
    return spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)], "row int, col int, z double")


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r["z"] is None else r["z"]
    return out


def dense(z, tension):
    """The same energy's minimum by solving for all voids at once."""
    n = z.size
    whole = np.stack([splines.bending(e.reshape(z.shape), tension).ravel() for e in np.eye(n)])
    assert whole == pytest.approx(whole.T)
    free, out = np.isnan(z).ravel(), z.copy().ravel()
    out[free] = np.linalg.solve(whole[np.ix_(free, free)], -whole[np.ix_(free, ~free)] @ out[~free])
    return out.reshape(z.shape)


@pytest.mark.parametrize("tension", [0.0, 0.35, 1.0])
def test_bending_is_the_gradient_of_the_energy(tension):
    rng = np.random.default_rng(3)
    z = rng.random((5, 7))

    def energy(z):
        second = sum((np.diff(z, 2, axis) ** 2).sum() for axis in (0, 1)) + 2 * (np.diff(np.diff(z, axis=0), axis=1) ** 2).sum()
        return (1 - tension) * second + tension * sum((np.diff(z, axis=axis) ** 2).sum() for axis in (0, 1))

    for i, j in ((0, 0), (2, 3), (4, 6), (1, 5)):
        step = np.zeros_like(z)
        step[i, j] = 1e-4
        assert (energy(z + step) - energy(z - step)) / 4e-4 == pytest.approx(splines.bending(z, tension)[i, j], abs=1e-6)


@pytest.mark.parametrize(("tension", "tile", "halo"), [(0.35, 64, 16), (0.35, 8, 4), (0.0, 8, 6), (1.0, 8, 4)])
def test_splines_equal_a_dense_solution(spark, tension, tile, halo):
    rng = np.random.default_rng(7)
    z = np.where(rng.random((18, 23)) < 0.12, rng.normal(0, 10, (18, 23)), np.nan)
    got = array(splines.interp_spline(table(spark, z), tension, 1e-6, tile, halo), z.shape)
    data = ~np.isnan(z)
    assert (got[data] == z[data]).all() and not np.isnan(got).any()
    assert np.abs(got - dense(z, tension)).max() < 1e-3 * np.ptp(z[data])
    # what is left of the gradient, beside that of the data alone
    left = np.where(data, 0, splines.bending(got, tension))
    assert np.abs(left).max() < 1e-3 * np.abs(splines.bending(np.where(data, z, np.nanmean(z)), tension)).max()


def test_a_thin_plate_keeps_planes_and_nothing_comes_of_nothing(spark):
    plane = np.fromfunction(lambda r, c: 3 * r - 2 * c + 5.0, (20, 21))
    z = np.where(np.random.default_rng(0).random(plane.shape) < 0.2, plane, np.nan)
    assert array(splines.interp_spline(table(spark, z), 0.0, 1e-7, 16, 6), z.shape) == pytest.approx(plane, abs=0.01)
    assert np.isnan(array(splines.interp_spline(table(spark, np.full((4, 5), np.nan))), (4, 5))).all()


def test_a_round_of_a_spline_writes_a_row_for_a_line_of_a_tile(spark, monkeypatch):
    sizes = []

    def stash(df, label, own=splines.stash):
        sizes.append((df := own(df, label)).count())
        return df

    monkeypatch.setattr(splines, "stash", stash)
    z = np.full((40, 20), np.nan)
    z[::4, ::4] = np.random.default_rng(2).random((10, 5))
    got = array(splines.interp_spline(table(spark, z), tile=8, halo=4), z.shape)
    assert not np.isnan(got).any() and (got[::4, ::4] == z[::4, ::4]).all()
    # by level 5 x 3, 10 x 5, 20 x 10 and 40 x 20 cells, in tiles of 8
    assert sizes[0] == 5 and set(sizes) == {5, 10, 20 * 2, 40 * 3}


def test_a_tile_is_sent_what_it_sees_of_segments(spark):
    rows, cols, tile, reach = 19, 23, 4, 6
    for k in (1, 2):
        n, m = -(-rows // k), -(-cols // k)
        z = np.arange(n * m, dtype=float).reshape(n, m)
        own = [(r, t, z[r, t * tile : (t + 1) * tile].tolist(), [False] * len(z[r, t * tile : (t + 1) * tile])) for r in range(n) for t in range(-(-m // tile))]
        sent = splines._dealt(spark.createDataFrame(own, "row int, tj int, z array<double>, fixed array<boolean>"), tile, reach, rows, cols, k)
        got = sorted((r["ti"], r["tj"], v) for r in sent.collect() for v in r["z"])
        sees = lambda t, x: t * tile - reach <= k * x < (t + 1) * tile + reach  # noqa: B023, E731
        assert got == sorted((i, j, z[r, c]) for i in range(5) for j in range(6) for r in range(n) for c in range(m) if sees(i, r) and sees(j, c))


def test_lines_weighted_by_cubic_convolution_equal_align(spark):
    z = np.random.default_rng(5).random((9, 11))
    unit, wide = (GridSpec(Region(0.0, 1.0, -1.0, 0.0), float(i), float(i)) for i in (1, 2))
    want = array(rasters.align(table(spark, np.zeros((17, 22))), unit, table(spark, z), wide, "cubic"), (17, 22))
    assert splines._cubic((0, 17), (0, 9)) @ z @ splines._cubic((0, 22), (0, 11)).T == pytest.approx(want, abs=1e-12)


def test_cubic_convolution_of_quadratics_and_beside_voids(spark):
    f = lambda x, y: x * x - 2 * x * y + 3 * y
    own, fine = GridSpec(Region(0, 20, 0, 20), 2.0, 2.0), GridSpec(Region(0, 20, 0, 20), 0.5, 0.5)
    z = np.array([[float(f(c * 2 + 1, 20 - r * 2 - 1)) for c in range(10)] for r in range(10)])
    cells = spark.range(1600).selectExpr("CAST(id DIV 40 AS INT) AS row", "CAST(id % 40 AS INT) AS col", "0D AS z")
    got = array(rasters.align(cells, fine, table(spark, z), own, "cubic"), (40, 40))
    want = np.array([[f(c * 0.5 + 0.25, 20 - r * 0.5 - 0.25) for c in range(40)] for r in range(40)])
    assert got[8:32, 8:32] == pytest.approx(want[8:32, 8:32]) and not np.isnan(got).any()
    z[:] = 7.0
    z[:, 6:] = np.nan
    got = array(rasters.align(cells, fine, table(spark, z), own, "cubic"), (40, 40))
    assert got[:, :23] == pytest.approx(np.full((40, 23), 7.0)) and np.isnan(got[:, 28:]).all()
    w = spark.range(1).select(*[filters.cubic_weight(F.lit(t)) for t in (0.0, 0.5, 1.0, 1.5, 2.0, -0.5)]).first()
    assert tuple(w) == pytest.approx((1, 0.5625, 0, -0.0625, 0, 0.5625))


def test_cubic_sampling_makes_one_row_of_a_point(spark):
    rng = np.random.default_rng(11)
    z = np.where(rng.random((9, 12)) < 0.6, rng.normal(0, 10, (9, 12)), np.nan)
    own = GridSpec(Region(0, 24, 0, 18), 2.0, 2.0)
    at = [(i, *p) for i, p in enumerate(rng.uniform(-5, 28, (300, 2)).tolist())] + [(300, 3.0, 5.0), (301, 1e12, 1.0), (302, None, 1.0), (303, 12.0, 2.0)]
    found = filters.sample_cubic(spark.createDataFrame(at, "seq long, x double, y double").withColumn("twice", F.col("seq") * 2), table(spark, z), own, "z", "ref", ["seq", "twice"])
    # what is exploded is not a point
    depth, inside = None, []
    for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines():
        here = len(line) - len(line.lstrip(" :+-"))
        depth = None if depth is not None and here <= depth else depth
        inside += [line] if depth is not None else []
        depth = here if depth is None and "Generate" in line else depth
    assert inside and not any("seq#" in line for line in inside)

    def kernel(t):
        t = abs(t)
        return 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0

    want = {}
    for seq, x, y in at:
        met = [] if x is None else [(kernel(x / 2 - 0.5 - c) * kernel((18 - y) / 2 - 0.5 - r), z[r, c]) for r in range(9) for c in range(12) if not np.isnan(z[r, c])]
        whole = sum(w for w, _ in met)
        want[seq] = sum(w * v for w, v in met) / whole if whole >= 0.25 else None
    got = {r["seq"]: r["ref"] for r in found.collect() if r["twice"] == 2 * r["seq"]}
    assert got.keys() == want.keys() and {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items() if v is not None) and sum(v is not None for v in want.values()) > 80


def test_levels_go_on_by_themselves():
    assert surfaces.cudem_levels(2, (1.0, 0.5), (1, 3)) == {"factors": (9, 3, 1), "weights": (0.25, 0.5, 1.0)}
    assert surfaces.cudem_levels(1) == {"factors": (3, 1), "weights": (0.5, 1.0)} and surfaces.cudem_levels(0)["factors"] == (1,)


def test_quadrants_by_brute_force(spark):
    rng = np.random.default_rng(5)
    z = np.where(rng.random((14, 17)) < 0.15, rng.random((14, 17)), np.nan)
    got = array(rasters.fill_quadrants(table(spark, z), 5.5), z.shape)
    for (r, c), v in np.ndenumerate(z):
        if not np.isnan(v):
            assert got[r, c] == v
            continue
        near = []
        for s in (1, -1):
            for t in (1, -1):
                own = [((i - r) ** 2 + (j - c) ** 2, i, j) for i, j in np.argwhere(~np.isnan(z)) if (i - r) * s >= 0 and (j - c) * t >= 0 and (i - r) ** 2 + (j - c) ** 2 <= 5.5**2]
                near += [min(own)] if own else []
        want = sum(z[i, j] / math.sqrt(d) for d, i, j in near) / sum(1 / math.sqrt(d) for d, _, _ in near) if near else np.nan
        assert got[r, c] == pytest.approx(want, nan_ok=True)
    smooth = array(rasters.fill_quadrants(table(spark, z), 5.5, 3), z.shape)
    assert (smooth[~np.isnan(z)] == z[~np.isnan(z)]).all() and (np.isnan(smooth) == np.isnan(got)).all()
    assert np.isnan(array(rasters.fill_quadrants(table(spark, np.full((3, 3), np.nan)), 2), (3, 3))).all()


def test_mosaic_takes_the_first_source(spark):
    a, b = GridSpec(Region(0, 4, 0, 4), 1.0, 1.0), GridSpec(Region(-2, 8, -2, 8), 2.0, 2.0)
    hole = np.full((4, 4), 1.0)
    hole[0, 0] = np.nan
    cells, grid = rasters.mosaic([(table(spark, hole), a), (table(spark, np.full((5, 5), 2.0)), b)], GridSpec(Region(0, 4, 0, 4), 1.0, 1.0), buffer=0.5)
    got = array(cells, (6, 6))
    assert (grid.region, got.shape) == (Region(-1, 5, -1, 5), (grid.rows, grid.cols))
    inner = np.where(np.isnan(hole), 2.0, 1.0)
    assert (got[1:5, 1:5] == inner).all() and (got[0] == 2).all()


def test_manifest_of_a_folder(spark, tmp_path):
    for i in range(4):
        (tmp_path / "d" / str(i)).mkdir(parents=True)
        (tmp_path / "d" / str(i) / "p.xyz").write_text(f"{10 * i} 0 1\n{10 * i + 5} 5 2\n")
    (tmp_path / "d" / "empty.xyz").write_text("# nothing\n")
    (tmp_path / "d" / "0" / "p.xyz.inf").write_text(json.dumps({"min_x": 100, "max_x": 101, "min_y": 0, "max_y": 1}))  # what a sidecar says counts
    (tmp_path / "d" / "1" / "p.xyz.inf").write_text("no bounds")
    built = manifest.build(spark, str(tmp_path / "d"), "xyz", str(tmp_path / "m"))
    assert sorted((r["w"], r["e"]) for r in built.collect()) == [(10, 15), (20, 25), (30, 35), (100, 101)]
    assert json.loads((tmp_path / "d" / "2" / "p.xyz.inf").read_text()) == {"min_x": 20, "max_x": 25, "min_y": 0, "max_y": 5}
    got = manifest.read_folder(built, Region(12, 22, 4, 9), "xyz", weight=2.0)
    assert sorted((r["x"], r["w"]) for r in got.collect()) == [(10, 2), (15, 2), (20, 2), (25, 2)]
    os.remove(tmp_path / "d" / "3" / "p.xyz")  # a file that is not met is not opened
    assert got.count() == 4 and manifest.read_folder(built, Region(500, 600, 0, 1), "xyz").count() == 0
    assert manifest.build(spark, str(tmp_path / "d"), "xyz", str(tmp_path / "n"), make=False).count() == 3


def test_z_order(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.3, 0.8), (0.5, 0.0)], "x double, y double")
    got = [r[0] for r in rows.select(manifest.z_order(F.col("x"), F.col("y"), 4)).collect()]
    plain = lambda x, y: sum(((min(15, int(x * 16)) >> i) & 1) << (2 * i) | ((min(15, int(y * 16)) >> i) & 1) << (2 * i + 1) for i in range(4))
    assert got == [plain(*p) for p in ((0, 0), (1, 1), (0.3, 0.8), (0.5, 0))]


def test_sides_of_a_grid_are_not_broadcast(spark):
    """A written grid of few bytes may have any number of cells."""
    z = np.where(np.random.default_rng(9).random((12, 14)) < 0.2, np.nan, 1.0)
    wall = [[(3.3, 20.0), (9.3, 20.0), (9.3, -20.0), (3.3, -20.0)]]
    out = rasters.by_side(table(spark, z), GridSpec(Region(0, 14, 0, 12), 1.0, 1.0), [wall], lambda c: rasters.fill_idw(c, 2))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftSemi" in line or ("Join Inner" in line and "_br" in line)]
    assert len(joins) == 4 and all("strategy=merge" in line for line in joins)
    assert out.count() == z.size
