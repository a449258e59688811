"""Edges, ties and sources on small hand-written inputs."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.grid import GridSpec, Region, geographic, mercator, parse_resolution
from tidegrid.operators import filters, rasters, stacks
from tidegrid.sources import readers
from tidegrid.streaming import incremental

GRID = GridSpec(Region(0, 4, 0, 4), 1.0, 1.0)
POINT = "seq int, dataset_id string, x double, y double, z double, w double, u double, classification int"


def points(spark, *rows):
    return spark.createDataFrame([(i, "a", *map(float, r), 1.0, 0.0, 0) for i, r in enumerate(rows)], POINT)


def classes(df):
    return {r["seq"]: r["classification"] for r in df.collect()}


def test_resolution_and_size():
    assert parse_resolution("3s") == (3 / 3600, 3 / 3600)
    assert parse_resolution("1/2") == (1.0, 2.0)
    assert GridSpec.of(Region(0, 0.5, 0, 1), "1s").cols == 1800
    assert GridSpec.of(Region(0, 1, 0, 1), "0.3").cols == 3


def test_edges_of_the_grid(spark):
    p = points(spark, (0, 4, 1), (4, 2, 1), (2, 0, 1), (3.5, 0.5, 1))
    assert {(r["seq"], r["row"], r["col"]) for r in GRID.index(p).collect()} == {(0, 0, 0), (3, 3, 3)}


def test_empty_points(spark):
    p = points(spark).limit(0)
    for df in (filters.outlierz(p), filters.block_thin(p), filters.coplanarz(p, 1, 1), stacks.simple_stack(p, GRID), stacks.point_pixels(p, GRID)):
        assert df.count() == 0


def test_outliers_need_three_points_and_spread(spark):
    assert set(classes(filters.outlierz(points(spark, (0, 0, 1), (0, 0, 99)), 0.1)).values()) == {0}
    assert set(classes(filters.outlierz(points(spark, (0, 0, 5), (0, 0, 5), (1, 1, 5)), 0.1)).values()) == {0}


def test_block_ties_go_to_the_first(spark):
    assert classes(filters.block_minmax(points(spark, (0, 0, 1), (0.1, 0, 1), (3, 3, 0)), 1.0)) == {0: 0, 1: 7, 2: 0}


def test_percent_of_zero_reference(spark):
    ref = spark.createDataFrame([(3, 0, 0.0)], "row int, col int, ref_z double")
    got = classes(filters.rq(points(spark, (0.5, 0.5, 0), (0.6, 0.5, 1), (2, 2, 1)), ref, GRID, "ref_z", 10, "percent"))
    assert got == {0: 0, 1: 7, 2: 0}


def test_tie_votes_are_water(spark):
    cells = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 0, -1.0)], "dataset_id string, row int, col int, z double")
    assert stacks.coastline_votes(cells, {"a": 5, "b": 5}).first()["land"] == 0


def test_weights_of_zero_give_null(spark):
    p = points(spark, (0.5, 0.5, 3)).withColumn("w", F.lit(0.0))
    assert stacks.simple_stack(p, GRID).first()["z"] is None


def test_slope_of_a_plane(spark):
    cells = spark.createDataFrame([(r, c, 3.0 * r + 4.0 * c) for r in range(4) for c in range(4)], "row int, col int, z double")
    assert {round(r["slope"], 9) for r in rasters.slope(cells).collect()} == {5.0}


def test_mercator_round_trip(spark):
    p = points(spark, (10, 20, 0), (-170, -60, 0))
    m = p.select("x", "y", mercator()[0].alias("mx"), mercator()[1].alias("my"))
    for r in m.select("x", "y", geographic("mx", "my")[0].alias("a"), geographic("mx", "my")[1].alias("b")).collect():
        assert (r["a"], r["b"]) == pytest.approx((r["x"], r["y"]))


def test_xyz(spark, tmp_path):
    f = tmp_path / "a.xyz"
    f.write_text("# a comment\n1 2 3\n4,5,6\nbad line here\n\n7;8;9;2\n")
    assert sorted(tuple(r)[:3] for r in readers.read_points(spark, str(f)).collect()) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0), (7.0, 8.0, 9.0)]
    g = tmp_path / "b.csv"
    g.write_text("id,lat,lon,depth\na,50.0,1.0,12.5\n")
    assert readers.read_points(spark, str(g), "nos_xyz").select("x", "y", "z").first()[:] == (1.0, 50.0, -12.5)


def test_geojson(spark, tmp_path):
    hole = [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]
    shapes = [
        ({"type": "Point", "coordinates": [1, 2, 3]}, {}),
        ({"type": "Polygon", "coordinates": hole}, {"elevation": 7}),
        ({"type": "MultiPolygon", "coordinates": [hole]}, {}),
        ({"type": "GeometryCollection", "geometries": [{"type": "LineString", "coordinates": [[0, 0, 5], [1, 1]]}]}, {}),
    ]
    f = tmp_path / "a.geojson"
    f.write_text(json.dumps({"type": "FeatureCollection", "features": [{"geometry": g, "properties": p} for g, p in shapes]}))
    z = sorted(r["z"] for r in readers.read_geojson(spark, str(f)).collect())
    assert z == [3.0, 5.0] + [7.0] * 8


def test_las_classes(spark, tmp_path):
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = b"\x01\x02"
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<BHI", head, 104, 0, 20, 2)
    struct.pack_into("<3d", head, 131, 0.01, 0.01, 0.01)
    record = lambda x, c: struct.pack("<3i", x, 200, 300) + b"\0\0\0" + bytes([c]) + b"\0" * 4
    f = tmp_path / "a.las"
    f.write_bytes(bytes(head) + record(100, 2) + record(500, 7))
    assert [r[:3] for r in readers.read_las(spark, str(f)).collect()] == [pytest.approx((1.0, 2.0, 3.0))]


def test_each_dataset_is_ingested_once(spark, tmp_path):
    folder = str(tmp_path / "sums")
    a, b = points(spark, (0.5, 0.5, 2)), points(spark, (0.5, 0.5, 4)).withColumn("dataset_id", F.lit("b"))
    for p in (a, a, a.unionByName(b)):
        incremental.ingest(p, GRID, folder)
    known = spark.createDataFrame([("a", 0), ("b", 1)], "dataset_id string, ingest_order int")
    cell = incremental.current(spark, folder, known).first()
    assert (cell["z"], cell["count"]) == (3.0, 2)


def test_streamed_ingest(spark, tmp_path):
    landing = str(tmp_path / "in")
    points(spark, (0.5, 0.5, 2), (1.5, 0.5, 8)).write.parquet(landing)
    stream = spark.readStream.schema(POINT).parquet(landing)
    incremental.ingest_stream(stream, GRID, str(tmp_path / "sums"), str(tmp_path / "cp")).awaitTermination()
    known = spark.createDataFrame([("a", 0)], "dataset_id string, ingest_order int")
    assert sorted(r["z"] for r in incremental.current(spark, str(tmp_path / "sums"), known).collect()) == [2.0, 8.0]


def test_xyz_writer(spark, tmp_path):
    readers.write_xyz(points(spark, (1, 2, 3)), str(tmp_path / "out"), 2)
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "1.00 2.00 3.00 1.00 0.00"


def test_points_of_no_dataset_stay(spark):
    p = points(spark, (0, 0, 1), (0, 0, 2), (0, 0, 1), (0, 0, 90)).withColumn("dataset_id", F.when(F.col("seq") > 9, "a"))
    assert classes(filters.outlierz(p, 1.5)) == {0: 0, 1: 0, 2: 0, 3: 7}
    assert classes(filters.outlierz(p, 1.5, scope=())) == {0: 0, 1: 0, 2: 0, 3: 7}


def test_void_cells_stay_among_flats(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (0, 2, None), (0, 3, 4.0)], "row int, col int, z double")
    assert sorted((r["col"], r["z"]) for r in rasters.flats_filter(cells, 1).collect()) == [(0, None), (1, None), (2, None), (3, 4.0)]
    assert rasters.flats_filter(cells).count() == 4


@pytest.mark.parametrize("n", [63, 64])
def test_provenance_of_many_modules(spark, n):
    p = spark.createDataFrame([(i, f"d{i}", 0.5, 0.5, 1.0, 1.0, 0.0, 0) for i in range(n)], POINT)
    known = spark.createDataFrame([(f"d{i}", f"m{i}", i) for i in range(n)], "dataset_id string, module string, ingest_order int")
    if n == 63:
        assert stacks.provenance(p, known, GRID).first()["mask"] == (1 << 63) - 1
    else:
        with pytest.raises(Exception, match="63 modules"):
            stacks.provenance(p, known, GRID).collect()


def test_a_dataset_in_two_batches_is_whole(spark, tmp_path):
    folder = str(tmp_path / "sums")
    p = points(spark, (0.5, 0.5, 2), (0.5, 0.5, 4), (0.5, 0.5, 9))
    for part in (0, 1, 1, 2):
        incremental.ingest_batch(p.filter(F.col("seq") == part), GRID, folder, f"b{part}")
    known = spark.createDataFrame([("a", 0)], "dataset_id string, ingest_order int")
    whole = stacks.multi_stack(p, known, GRID).first()
    got = incremental.current(spark, folder, known).first()
    assert got["count"] == 3 and tuple(got) == pytest.approx(tuple(whole))


def test_a_polygon_of_ten_thousand_sides(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    t = np.arange(10_000) * 2 * np.pi / 10_000
    r = 3 + np.sin(50 * t) + rng.random(10_000) * 0.2
    ring = np.column_stack([r * np.cos(t), r * np.sin(t)])
    xy = rng.uniform(-5, 5, (300, 2))
    after = np.roll(ring, -1, axis=0)
    inside = []
    for x, y in xy:
        spans = (ring[:, 1] > y) != (after[:, 1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (after[:, 0] - ring[:, 0]) * (y - ring[:, 1]) / (after[:, 1] - ring[:, 1]) + ring[:, 0]
        inside.append(int((spans & (x < at)).sum() % 2))
    got = classes(filters.vector_mask(points(spark, *[(x, y, 0) for x, y in xy]), [[[tuple(map(float, v)) for v in ring]]]))
    assert [got[i] for i in range(300)] == [7 * k for k in inside]
    assert 30 < sum(inside) < 270
    assert set(classes(filters.vector_mask(points(spark, (0, 0, 1)), [])).values()) == {0}


def test_bounding_polygon(spark):
    got = stacks.stream_inf(points(spark, (0.5, 1, 2), (3, -4.25, 9))).select(stacks.bounds_wkt()).first()[0]
    assert got == "POLYGON ((0.5 -4.25, 0.5 1, 3 1, 3 -4.25, 0.5 -4.25))"


def test_thinning_keeps_columns(spark):
    p = points(spark, (1, 1, 5), (1.2, 1, 3), (9, 9, 1)).withColumn("_x0", F.lit("mine"))
    assert filters.block_thin(p.drop("_x0"), 5.0).columns == p.drop("_x0").columns
    assert sorted(r["seq"] for r in filters.block_thin(p.drop("_x0"), 5.0, soft=False).collect()) == [1, 2]


def test_geojson_fields(spark, tmp_path):
    f = tmp_path / "a.geojsonl"
    nested = {"type": "GeometryCollection", "geometries": [{"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [5, 6]}]}]}
    rows = [({"type": "Point", "coordinates": [1, 2]}, {"DEPTH": "4", "q": 3, "layer": "SOUNDG"}), (nested, {"depth": 1, "layer": "SOUNDG"}), (nested, {"depth": 1, "layer": "M_COVR"})]
    f.write_text("\n".join(json.dumps({"geometry": g, "properties": p}) for g, p in rows))
    got = sorted(tuple(r) for r in readers.read_points(spark, str(f), "charts_000", weight_field="q").select("x", "y", "z", "w").collect())
    assert got == [(1.0, 2.0, -4.0, 3.0), (5.0, 6.0, -1.0, 1.0)]


def test_coplanar_neighbours_of_crowded_places(spark, monkeypatch):
    """Points at one place are compared once, and crowded buckets are dealt out: the same flags as by brute force."""
    monkeypatch.setattr(filters, "_CROWD", 3)
    rows = [((i * 7) % 11 / 4, (i * 5) % 13 / 4, float((i * 37) % 17)) for i in range(120)] + [(1.0, 1.0, float(i)) for i in range(10)] + [(-50.0, -50.0, 1.0)]

    def flagged(x, y, z):
        near = [p for p in rows if (p[0] - x) ** 2 + (p[1] - y) ** 2 <= 1]
        a = np.array([(1, p[0] - x, p[1] - y) for p in near])
        return len(near) < 4 or (np.linalg.matrix_rank(a) == 3 and abs(z - np.linalg.lstsq(a, np.array([p[2] for p in near]), rcond=None)[0][0]) > 3.01)

    want = {i: 7 if flagged(*p) else 0 for i, p in enumerate(rows)}
    assert classes(filters.coplanarz(points(spark, *rows), 1.0, 3.01)) == want and 0 < sum(v == 7 for v in want.values()) < len(rows)
