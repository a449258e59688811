"""Triangles, rings and overlays against brute force and exact shapes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid import catalog_shapes
from tidegrid.functions.grid import GridSpec, Region
from tidegrid.operators import coastlines, overlay, rings, surfaces, triangles
from tidegrid.operators.filters import crossings, inside_polygons, polygon_edges


def table(spark, z):
    return spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)], "row int, col int, z double")


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r["z"] is None else r["z"]
    return out


# triangles
def plain_triangle(points, v, sides):
    """The one triangle around v whose lifted plane lies under all other points, by trying all."""
    for i in range(len(points)):
        for j in range(len(points)):
            for k in range(len(points)):
                t = points[[i, j, k]]
                if i < min(j, k) and triangles._cross(*(t[1] - t[0]), *(t[2] - t[0])) > 0 and all(sides.of(t[a], t[(a + 1) % 3], v) > 0 for a in range(3)):
                    at = t.tolist()
                    if all(triangles._exact(at, q) > (0, 0, 0) for q in points.tolist() if q not in at):
                        return {i, j, k}
    return None


@pytest.mark.parametrize("seed", range(3))
def test_enclosing_triangles_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    cells = np.array([(x, y) for x in range(7) for y in range(7)])
    data = rng.random(49) < 0.25
    points, voids = cells[data], cells[~data][::4]
    corners = triangles.hull_of([tuple(map(int, p)) for p in points])
    place = {tuple(p): i for i, p in enumerate(points.tolist())}
    own = np.array([place[c] for c in corners])
    got = triangles.enclosing(points, voids, own)
    for t, v in zip(got, voids, strict=True):
        assert (set(t.tolist()) if t[0] >= 0 else None) == plain_triangle(points, v, triangles.Sides(points[own]))


def whole(z, cubic=None):
    """All voids in one piece; `cubic`: gradients by cell (rows, cols, 2)."""
    data = ~np.isnan(z)
    points, voids = np.argwhere(data)[:, ::-1], np.argwhere(~data)[:, ::-1]
    place = {tuple(p): i for i, p in enumerate(points.tolist())}
    t = triangles.enclosing(points, voids, np.array([place[c] for c in triangles.hull_of([tuple(map(int, p)) for p in points])]))
    ok = t[:, 0] >= 0
    t, v = t[ok], voids[ok]
    w, out = triangles.barycentric(points[t], v), z.copy()
    g = None if cubic is None else cubic[data][t]
    out[v[:, 1], v[:, 0]] = (w * z[data][t]).sum(1) if cubic is None else triangles.clough_tocher(points[t], z[data][t], g, w)
    return out


@pytest.mark.parametrize(("share", "tile", "halo"), [(0.02, 8, 2), (0.3, 16, 4)])
def test_tiles_give_the_triangles_of_the_whole_grid(spark, share, tile, halo):
    rng = np.random.default_rng(int(share * 100))
    z = np.where(rng.random((30, 37)) < share, rng.random((30, 37)), np.nan)
    got = array(triangles.interp_triangles(table(spark, z), tile=tile, halo=halo), z.shape)
    assert got == pytest.approx(whole(z), nan_ok=True) and np.isnan(got).any()


def test_a_great_hole_needs_cells_from_afar(spark):
    z = np.fromfunction(lambda r, c: 2 * r - 3 * c + 1.0, (40, 40))
    z[3:37, 3:37] = np.nan
    z[20, 20] = 100.0
    got = array(triangles.interp_triangles(table(spark, z), tile=8, halo=1), z.shape)
    assert got == pytest.approx(whole(z)) and got[20, 20] == 100


def test_a_lattice_needs_no_cells_from_afar(spark, monkeypatch):
    z = np.full((37, 22), np.nan)
    z[::4, ::4] = np.random.default_rng(8).random(z[::4, ::4].shape)
    handed, unseen = [], triangles._unseen
    monkeypatch.setattr(triangles, "_unseen", lambda *a: handed.append(unseen(*a)) or handed[-1])
    got = array(triangles.interp_triangles(table(spark, z), tile=8, halo=3), z.shape)
    assert got == pytest.approx(whole(z), nan_ok=True)
    assert sum(h.count() for h in handed) == 0 and len(handed) <= 1


def test_triangles_of_single_voids_are_found_nearby(monkeypatch):
    rows, cols = np.mgrid[:40, :40]
    data = (rows * 7 + cols) % 13 != 0
    points, voids = np.argwhere(data)[:, ::-1], np.argwhere(~data)[:, ::-1]
    place = {tuple(p): i for i, p in enumerate(points.tolist())}
    compared, lowest = [], triangles._lowest
    monkeypatch.setattr(triangles, "_lowest", lambda p, t: compared.append(len(t)) or lowest(p, t))
    own = [place[c] for c in triangles.hull_of([tuple(map(int, p)) for p in points])]
    found = triangles.enclosing(points, voids, np.array(own))
    assert (found[:, 0] >= 0).sum() > 110 and sum(compared) < 4 * len(voids)  # from the hull on, each void takes ten and more
    inside = found[:, 0] >= 0
    assert (lowest(points, found[inside]) < 0).all() and (triangles.barycentric(points[found[inside]], voids[inside]) > -1e-9).all()


def test_planes_come_back_by_either_method(spark):
    z = np.fromfunction(lambda r, c: 2 * r - 3 * c + 1.0, (12, 13))
    holes = np.where(np.random.default_rng(4).random(z.shape) < 0.6, np.nan, z)
    for method in ("linear", "cubic"):
        got = array(triangles.interp_triangles(table(spark, holes), method), z.shape)
        assert got[~np.isnan(got)] == pytest.approx(z[~np.isnan(got)]) and np.isnan(got).sum() < np.isnan(holes).sum() / 4


def test_clough_tocher_quadratics_and_smooth_joins():
    f = lambda p: p[..., 0] ** 2 - 3 * p[..., 0] * p[..., 1] + 2 * p[..., 1] ** 2 + p[..., 0]
    slope = lambda p: np.stack((2 * p[..., 0] - 3 * p[..., 1] + 1, -3 * p[..., 0] + 4 * p[..., 1]), -1)
    rng = np.random.default_rng(1)
    p = np.array([[0.0, 0.0], [5.0, 1.0], [2.0, 6.0]])
    w = rng.dirichlet(np.ones(3), 50)
    at = np.repeat(p[None], 50, 0)
    assert triangles.clough_tocher(at, f(at), slope(at), w) == pytest.approx(f(w @ p))
    # two triangles with an edge in common and any slopes: values and slopes agree along the edge
    q = np.array([p[1], p[0], [3.0, -4.0]])
    values, slopes = rng.random(4), rng.random((4, 2))
    mine, other = [0, 1, 2], [1, 0, 3]
    for s in (0.1, 0.37, 0.8):
        on = p[0] + s * (p[1] - p[0])
        step = 1e-5 * np.array([-1.0, 5.0]) / math.sqrt(26)  # across the edge

        def value(corners, own, v):
            return triangles.clough_tocher(corners[None], values[own][None], slopes[own][None], triangles.barycentric(corners[None], v[None]))[0]

        assert value(p, mine, on) == pytest.approx(value(q, other, on))
        assert (value(p, mine, on + step) - value(p, mine, on)) == pytest.approx(value(q, other, on) - value(q, other, on - step), abs=1e-9)


def test_cubic_tiles_equal_the_whole_grid(spark):
    rng = np.random.default_rng(6)
    z = np.where(rng.random((24, 25)) < 0.4, rng.random((24, 25)), np.nan)
    cells = table(spark, z)
    slopes = np.full((*z.shape, 2), np.nan)
    for r in triangles.gradients(cells.filter("z IS NOT NULL"), cells).collect():
        slopes[r["row"], r["col"]] = [np.nan if r[g] is None else r[g] for g in ("gx", "gy")]
    # slopes by least squares over the 24 cells around
    for r, c in np.argwhere(~np.isnan(z))[::7]:
        rows = [(j - c, i - r, z[i, j] - z[r, c]) for i in range(max(0, r - 2), min(24, r + 3)) for j in range(max(0, c - 2), min(25, c + 3)) if (i, j) != (r, c) and not np.isnan(z[i, j])]
        a = np.array(rows)
        root = 1 / np.sqrt((a[:, :2] ** 2).sum(1))
        assert slopes[r, c] == pytest.approx(np.linalg.lstsq(a[:, :2] * root[:, None], a[:, 2] * root, rcond=None)[0])
    assert not np.isnan(slopes[~np.isnan(z)]).any()
    got = array(triangles.interp_triangles(cells, "cubic", tile=8, halo=3), z.shape)
    assert got == pytest.approx(whole(z, slopes), nan_ok=True)


def test_data_on_a_line_none_or_all(spark):
    z = np.full((5, 6), np.nan)
    assert np.isnan(array(triangles.interp_triangles(table(spark, z)), z.shape)).all()
    z[2, 1] = z[2, 4] = 1
    assert (~np.isnan(array(triangles.interp_triangles(table(spark, z)), z.shape))).sum() == 2
    full = np.random.default_rng(0).random((5, 6))
    assert array(triangles.interp_triangles(table(spark, full)), z.shape) == pytest.approx(full)
    with pytest.raises(ValueError):
        triangles.interp_triangles(table(spark, full), "spline")


# rings
def test_rings_with_holes_pinches_and_islands(spark):
    z = np.array([[1, 1, 1, 1, 0], [1, 0, 1, 0, 1], [1, 1, 0, 1, 1], [1, 1, 1, 1, 0], [0, 0, 0, 0, 1]], float)
    grid = GridSpec(Region(10, 15, 20, 25), 1.0, 1.0)
    edges = rings.grid_rings(table(spark, z), F.col("z") == 1, grid).cache()
    shapes = {r["ring"]: r for r in rings.ring_shapes(edges, "label").collect()}
    # three holes touch one another, and one of them the outside, at corners only
    assert sorted(r["area"] for r in shapes.values()) == [-1, -1, -1, 1, 18]
    for r in edges.groupBy("ring").agg(F.sort_array(F.collect_list(F.struct("position", "x1", "y1", "x2", "y2"))).alias("e"), F.max("length").alias("n")).collect():
        e = r["e"]
        assert [x["position"] for x in e] == list(range(r["n"]))
        assert all((a["x2"], a["y2"]) == (b["x1"], b["y1"]) for a, b in zip(e, [*e[1:], e[0]], strict=True))
        assert all((a["x2"] - a["x1"]) * (b["x2"] - b["x1"]) + (a["y2"] - a["y1"]) * (b["y2"] - b["y1"]) == 0 for a, b in zip(e, [*e[1:], e[0]], strict=True))  # corners only
    got = {r["area"]: (r["holes"], r["wkt"]) for r in rings.patch_polygons(table(spark, z), F.col("z") == 1, grid).collect()}
    assert set(got) == {15.0, 1.0} and got[15.0][0] == 3 and got[1.0] == (0, "POLYGON ((15 21, 14 21, 14 20, 15 20, 15 21))")
    # the same without labels, and by point in ring
    loose = rings.link(edges.select("id", "x1", "y1", "x2", "y2"))
    assert sorted(r["area"] for r in rings.ring_shapes(loose).collect()) == [-1, -1, -1, 1, 18]
    nested = rings.nest(edges).collect()
    big = max(shapes, key=lambda k: shapes[k]["area"])
    assert {r["ring"]: r["shell"] for r in nested} == {k: big if s["label"] == shapes[big]["label"] else k for k, s in shapes.items()}
    assert rings.patch_polygons(table(spark, z), F.col("z") > 5, grid).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_ranks_of_long_chains(spark, n):
    ids = np.random.default_rng(n).permutation(n) + 7
    rows = [(int(a), int(b)) for a, b in zip(ids, np.roll(ids, -1), strict=True)]
    got = {r["id"]: r for r in rings.ranked(spark.createDataFrame(rows, "id long, next long")).collect()}
    start = list(ids).index(7)
    assert [got[int(i)]["position"] for i in np.roll(ids, -start)] == list(range(n))
    assert {(r["ring"], r["length"]) for r in got.values()} == {(7, n)}


def test_open_ends_are_left_out(spark):
    square = [(1, 0.0, 0.0, 1.0, 0.0), (2, 1.0, 0.0, 1.0, 1.0), (3, 1.0, 1.0, 0.0, 1.0), (4, 0.0, 1.0, 0.0, 0.0), (5, 5.0, 5.0, 6.0, 6.0), (6, 6.0, 6.0, 7.0, 6.0)]
    got = rings.link(spark.createDataFrame(square, "id long, x1 double, y1 double, x2 double, y2 double"))
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3, 4]


# overlays
def box(w, s, e, n):
    return [[(w, s), (e, s), (e, n), (w, n)]]


def areas(spark, a, b):
    ea, eb = polygon_edges(spark, a), polygon_edges(spark, b or [box(0, 0, 1, 1)])
    eb = eb if b else eb.limit(0)
    return {rule: overlay.area(overlay.overlay(ea, eb, rule)).first()["area"] for rule in ("union", "intersection", "difference", "symmetric")}


def test_overlay_of_boxes_that_cross_touch_and_share_sides(spark):
    a = [box(0, 0, 4, 4), box(3, 3, 6, 6), box(10, 0, 12, 2)]
    b = [box(2, -1, 3, 5), box(12, 0, 14, 2), box(10.5, 0.5, 11, 1)]
    u, i = 4 * 4 + 9 - 1 + 4, 1 * 4 + 0.25
    # 2..3 by -1..5 is 6, of which 4 lie in the first box; 12..14 shares a side; the last is a hole of the difference
    assert areas(spark, a, b) == {"union": u + 2 + 4, "intersection": i, "difference": u - i, "symmetric": u + 2 + 4 - i}
    got = {round(r["area"], 9): (r["holes"], r["wkt"]) for r in overlay.overlay_polygons(polygon_edges(spark, a), polygon_edges(spark, b), "difference").collect()}
    assert got[3.75][0] == 1 and sum(got) == pytest.approx(u - i)
    assert areas(spark, a, []) == {"union": u, "intersection": 0, "difference": u, "symmetric": u}
    with pytest.raises(ValueError):
        overlay.overlay(polygon_edges(spark, a), polygon_edges(spark, b), "minus")


def test_overlay_of_random_polygons_by_sample_points(spark):
    rng = np.random.default_rng(8)
    star = lambda: [[(x + r * math.cos(t), y + r * math.sin(t)) for t, r in zip(np.arange(7) * 2 * math.pi / 7, rng.uniform(0.5, 2, 7), strict=True)] for x, y in [rng.uniform(0, 8, 2)]]
    a, b = [star() for _ in range(9)], [star() for _ in range(6)]
    ea, eb = polygon_edges(spark, a), polygon_edges(spark, b)
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-1, 9, (800, 2)))], "seq long, x double, y double")
    inside = lambda e: {r["seq"] for r in inside_polygons(pts, e).collect()}
    ia, ib = inside(ea), inside(eb)
    for rule, want in (("union", ia | ib), ("intersection", ia & ib), ("difference", ia - ib), ("symmetric", ia ^ ib)):
        border = overlay.overlay(ea, eb, rule).cache()
        assert inside(border.withColumn("poly", F.lit(0))) == want
        linked = rings.link(border)
        assert linked.count() == border.count()  # all closed
        assert rings.nest(linked).filter("shell IS NULL").count() == 0


def test_what_one_polygon_holds_whole_is_not_cut(spark, monkeypatch):
    """Many polygons over one another inside a large one: only the border's edges are paired and tested."""
    rng = np.random.default_rng(5)
    turned = [[[(5 + r * math.cos(t + k * 2 * math.pi / 3), 5 + r * math.sin(t + k * 2 * math.pi / 3)) for k in range(3)]] for t, r in zip(rng.uniform(0, 2, 40), rng.uniform(1, 3, 40), strict=True)]
    sizes, plain = {}, overlay.stash

    def counted(df, label):
        out = plain(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(overlay, "stash", counted)
    border = overlay.overlay(polygon_edges(spark, [box(0, 0, 10, 10), *turned]), polygon_edges(spark, [box(-1, 4, 3, 6)]))
    assert overlay.area(border).first()["area"] == pytest.approx(102) and sizes["pieces"] < 20


def test_parts_closer_than_a_millionth_are_told_apart(spark):
    """A slit narrower than any step aside, and one as wide as the places that corners are rounded to."""
    a, b = [box(0, 0, 1, 1), box(3, 0, 4, 1)], [box(1 + 4e-7, 0, 2, 1), box(4 + 2e-9, 0, 5, 1)]
    got = areas(spark, a, b)
    assert got["union"] == pytest.approx(4 - 4e-7 - 2e-9, abs=1e-12) and got["intersection"] == 0
    assert got["difference"] == pytest.approx(2, abs=1e-12) and got["symmetric"] == pytest.approx(got["union"], abs=1e-12)


@pytest.mark.parametrize("seed", range(2))
def test_overlay_of_polygons_that_share_corners_and_parts_of_sides(spark, seed):
    """Triangles on few lattice points: most meet at corners, run along one another or touch with a corner."""
    rng = np.random.default_rng(seed)

    def some(n):
        corners = [rng.choice(36, 3, replace=False) for _ in range(n)]
        return [[[(float(c // 6), float(c % 6)) for c in three]] for three in corners]

    ea, eb = polygon_edges(spark, some(14)).cache(), polygon_edges(spark, some(10)).cache()
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-0.5, 5.5, (700, 2)))], "seq long, x double, y double").cache()
    inside = lambda e: {r["seq"] for r in inside_polygons(pts, e).collect()}
    ia, ib = inside(ea), inside(eb)
    borders = overlay.overlays(ea, eb, list(overlay._RULES)).cache()
    for rule, want in (("union", ia | ib), ("intersection", ia & ib), ("difference", ia - ib), ("symmetric", ia ^ ib), ("a", ia), ("b", ib)):
        border = borders.filter(F.col("rule") == rule)
        assert inside(border.withColumn("poly", F.lit(0))) == want
        ends = border.select(F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(1).alias("n")).union(border.select("x2", "y2", F.lit(-1)))
        assert ends.groupBy("x", "y").agg(F.sum("n").alias("n")).filter("n <> 0").count() == 0
    size = overlay.areas(borders).first()
    assert size["union"] == pytest.approx(size["a"] + size["b"] - size["intersection"]) and size["symmetric"] == pytest.approx(size["union"] - size["intersection"])
    assert size["difference"] == pytest.approx(size["a"] - size["intersection"])


def test_edges_of_crowded_polygons_meet_without_a_join(spark, monkeypatch):
    """So nothing that grows with the input is broadcast; and many blocks give what one block gives."""
    rng = np.random.default_rng(7)
    turned = lambda n, r: [[[(x + r * math.cos(t + k * 2 * math.pi / 5), y + r * math.sin(t + k * 2 * math.pi / 5)) for k in range(5)]] for x, y, t in rng.uniform(0, 4, (n, 3))]
    a, b = polygon_edges(spark, turned(60, 0.3)).cache(), polygon_edges(spark, turned(30, 0.6)).cache()
    whole = overlay.area(overlay.overlay(a, b, "symmetric")).first()["area"]

    def join(*_, **__):
        raise AssertionError("a join")

    monkeypatch.setattr(overlay, "_BLOCK", 40)
    with monkeypatch.context() as m:
        m.setattr(type(a), "join", join)
        border = overlay.overlay(a, b, "symmetric")
    assert overlay.area(border).first()["area"] == pytest.approx(whole, abs=1e-9)
    assert rings.link(border).count() == border.count()


def test_areas_tell_whether_the_rings_close(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    assert catalog_shapes.overlay_areas(spark, sf).first().asDict() == {"sums": True, "leaves": True, "some": True, "closed": True}
    plain = overlay.overlays
    monkeypatch.setattr(overlay, "overlays", lambda *a: (b := plain(*a)).filter(F.col("id") != b.filter("rule = 'union'").agg(F.min("id")).first()[0]))
    assert not catalog_shapes.overlay_areas(spark, sf).first()["closed"]


def test_areas_add_up_where_the_second_set_covers_the_first(spark, tmp_path):
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        spark.range(12).withColumnRenamed("id", key).write.parquet(f"{tmp_path}/{name}.parquet")
    assert catalog_shapes.overlay_areas(spark, str(tmp_path)).first().asDict() == {"sums": True, "leaves": True, "some": True, "closed": True}


def test_tall_edges_do_not_multiply(spark):
    """A fence of edges as tall as the region: as many spans as twice the edges at most, and right counts."""
    n = 200
    edges = spark.createDataFrame([(0, float(i), 0.0, i + 0.5, 100.0) for i in range(n)], "poly long, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(0, -1.0, 50.0), (1, 99.9, 50.0), (2, 300.0, 50.0), (3, -1.0, 100.0)], "seq long, x double, y double")
    assert {r["seq"]: r["n"] for r in crossings(pts, edges).collect()} == {0: n, 1: n - 100}


# coast lines
def segments(spark, *lines):
    return spark.createDataFrame([(*map(float, (*a, *b)),) for line in lines for a, b in zip(line, line[1:])], "x1 double, y1 double, x2 double, y2 double")


BAY = Region(0, 10, 0, 10)


def land(spark, *lines):
    return sorted((round(r["area"], 6), r["holes"]) for r in coastlines.land_polygons(segments(spark, *lines), BAY).collect())


def test_open_lines_close_along_the_border(spark):
    # land to the left of the way north is the west; of the way south the east
    assert land(spark, [(4, -1), (4, 5), (4, 11)]) == [(40, 0)]
    assert land(spark, [(4, 11), (4, 5), (4, -1)]) == [(60, 0)]
    # two lines: a strip of land between them, and then two lands on either side of water
    assert land(spark, [(6, -1), (6, 11)], [(4, 11), (4, -1)]) == [(20, 0)]
    assert land(spark, [(6, 11), (6, -1)], [(4, -1), (4, 11)]) == [(40, 0), (40, 0)]
    # a corner cut off, an island, a lake in land
    assert land(spark, [(3, -1), (3, 3), (-1, 3)]) == [(9, 0)]
    assert land(spark, [(-1, 3), (3, 3), (3, -1)]) == [(91, 0)]
    island = [(5, 5), (6, 5), (6, 6), (5, 6), (5, 5)]
    assert land(spark, island) == [(1, 0)] and land(spark, island[::-1]) == [(99, 1)]
    assert land(spark, [(4, -1), (4, 11)], island, [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]) == [(1, 0), (39, 1)]
    # a line that ends inside is left out, and so is all where there is no line
    assert land(spark, [(4, -1), (4, 5)], island) == [(1, 0)] and land(spark) == []
    # in and out by one side, over a corner, several times
    assert land(spark, [(11, 2), (8, 2), (8, 4), (11, 4)], [(11, 6), (9, 6), (9, 8), (11, 8)]) == [(94, 0)]
    assert land(spark, [(11, 4), (8, 4), (8, 2), (11, 2)]) == [(4, 0)]


def test_land_agrees_with_patches_of_cells(spark):
    turn = [2 * math.pi * i / 60 for i in range(60)]
    ring = [(5 + (4 + 2 * math.cos(5 * t)) * math.cos(t), 5 + (4 + 2 * math.cos(5 * t)) * math.sin(t)) for t in turn]
    lines = segments(spark, [*ring, ring[0]])
    border = coastlines.land_border(lines, BAY)
    assert border.filter(f"x1 = {BAY.e}").count() > 0
    grid = GridSpec(BAY, 0.125, 0.125)
    cells = grid.centres(surfaces.coast_patches(lines, grid, 1.0)).filter("land IS NOT NULL").withColumn("seq", F.col("row") * 1000 + F.col("col"))
    inside = {r["seq"] for r in crossings(cells, border.withColumn("poly", F.lit(0))).filter("n % 2 = 1").collect()}
    got = cells.select("seq", "land").collect()
    assert len(got) > 5000 and all((r["seq"] in inside) == r["land"] for r in got)


def test_a_long_open_line_takes_few_rounds(spark):
    line = [(i / 1000, 5 + (i % 2) / 10) for i in range(-1, 2000)]
    assert land(spark, line) == []


def test_a_region_without_a_coast_is_told_by_lines_outside(spark):
    around = [(-5, -5), (15, -5), (15, 15), (-5, 15), (-5, -5)]
    assert land(spark, around) == [(100, 0)] and land(spark, around[::-1]) == []
    # an island to the east, and one around the region whose lake is the region
    island = [(12, 2), (14, 2), (14, 8), (12, 8), (12, 2)]
    assert land(spark, island) == [] and land(spark, around, [(-1, -1), (-1, 11), (11, 11), (11, -1), (-1, -1)]) == []
