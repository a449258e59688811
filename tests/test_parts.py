"""Barriers, quantiles, aligned grids, coast patches, the registry and LAS records against brute force."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid import registry
from tidegrid.functions.grid import GridSpec, Region
from tidegrid.operators import rasters, stacks, surfaces
from tidegrid.sources import readers
from tidegrid.sources.las import LasRecords, reference_system

GRID = GridSpec(Region(0, 12, 0, 10), 1.0, 1.0)


def table(spark, z):
    return spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)], "row int, col int, z double")


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r["z"] is None else r["z"]
    return out


def test_by_side(spark):
    """What lies beyond the barrier is neither seen nor changed."""
    z = np.random.default_rng(2).random((10, 12))
    z[::3, ::2] = np.nan
    wall = [[(4.2, -1.0), (20.0, -1.0), (20.0, 20.0), (4.2, 20.0)]]
    fill = lambda c: rasters.fill_idw(c, 2)
    got = array(rasters.by_side(table(spark, z), GRID, [wall], fill), z.shape)
    left, right = z.copy(), z.copy()
    left[:, 4:], right[:, :4] = np.nan, np.nan
    want = np.where(np.arange(12) < 4, array(fill(table(spark, left)), z.shape), array(fill(table(spark, right)), z.shape))
    assert got == pytest.approx(want, nan_ok=True)
    assert rasters.by_side(table(spark, z), GRID, [wall], fill).count() == z.size


def test_quantiles(spark):
    for values in ([3.0], [1.0, 2.0], (np.random.default_rng(3).integers(0, 9, 400) / 4).tolist(), [5.0] * 50 + [None, 1.0]):
        known = [v for v in values if v is not None]
        row = stacks.quantiles(spark.createDataFrame([(v,) for v in values], "z double"), "z", {"a": 0.0, "b": 0.25, "c": 0.9, "d": 1.0}).first()
        assert list(row) == pytest.approx(list(np.quantile(known, [0, 0.25, 0.9, 1])))
    assert list(stacks.quantiles(spark.createDataFrame([], "z double"), "z", {"a": 0.5}).first()) == [None]


def test_align(spark):
    """A plane is the same on any grid, but for the edge, where a corner is missing."""
    half = GridSpec(GRID.region, 2.0, 2.0)
    fine = np.fromfunction(lambda r, c: 2 * r + 3 * c, (10, 12))
    coarse = fine.reshape(5, 2, 6, 2).mean((1, 3))
    got = array(rasters.align(table(spark, fine), GRID, table(spark, coarse), half), fine.shape)
    assert got[1:-1, 1:-1] == pytest.approx(fine[1:-1, 1:-1]) and np.isnan(got[0]).all()
    near = array(rasters.align(table(spark, fine), GRID, table(spark, coarse), half, "nearest"), fine.shape)
    assert near == pytest.approx(np.repeat(np.repeat(coarse, 2, 0), 2, 1))


def test_window_of():
    assert readers.window_of(GRID, Region(-5, 50, -5, 50)) == ((0, 9), (0, 11))
    assert readers.window_of(GRID, Region(2.5, 4.0, 1.0, 3.5)) == ((6, 8), (2, 3))


def test_coast_patches(spark):
    """A ring with the land inside, by a flood of the cells; turned round it is water inside."""
    ring = [(10.3, 5.2, 6.1, 9.4), (6.1, 9.4, 1.7, 5.2), (1.7, 5.2, 6.1, 0.9), (6.1, 0.9, 10.3, 5.2)]
    schema = "x1 double, y1 double, x2 double, y2 double"
    grid = GridSpec(GRID.region, 0.25, 0.25)
    got = {(r["row"], r["col"]): (r["label"], r["land"]) for r in surfaces.coast_patches(spark.createDataFrame(ring, schema), grid).collect()}
    todo, sea = [(0, 0)], {(0, 0)}
    while todo:
        r, c = todo.pop()
        for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            if n in got and n not in sea:
                sea.add(n)
                todo.append(n)
    assert got[(20, 24)][1] is True and (20, 24) not in sea
    assert all((land is False) == (cell in sea) for cell, (_, land) in got.items() if land is not None)
    assert len({label for cell, (label, _) in got.items() if cell in sea}) == 1
    back = surfaces.coast_patches(spark.createDataFrame([(c, d, a, b) for a, b, c, d in ring], schema), grid)
    assert {(r["row"], r["col"]): r["land"] for r in back.collect()}[(20, 24)] is False


def test_registry(spark):
    assert {"outlierz", "raster_cut", "simple_stack", "ms_blend", "land_surface"} <= set(registry.known("operator"))
    assert "read_xyz" in registry.known("source") and "read_xyz" not in registry.known("operator")
    assert registry.known()["range_z"]["options"][:2] == ["min_z", "max_z"]
    name = "test_only_half"
    registry.register(name, lambda points, by=2: points.withColumn("z", F.col("z") / by), about="x")
    points = spark.createDataFrame([(1.0, 5), (9.0, 5)], "z double, classification int")
    got = registry.chain(points, [("range_z", {"max_z": 4}), (name, {"by": 4})]).orderBy("z").collect()
    assert [tuple(r) for r in got] == [(0.25, 5), (2.25, 7)]
    with pytest.raises(ValueError):
        registry.register(name, len)
    with pytest.raises(KeyError):
        registry.chain(points, [("no such", {})])


def las(xyz, classes, variable=b"", n_variable=0) -> bytes:
    """An uncompressed file of version 1.2, point format 0."""
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HII", head, 94, 227, 227 + len(variable), n_variable)
    struct.pack_into("<BHI", head, 104, 0, 20, len(xyz))
    struct.pack_into("<3d3d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    rows = np.zeros(len(xyz), np.dtype({"names": ["p", "c"], "formats": ["(3,)<i4", "u1"], "offsets": [0, 15], "itemsize": 20}))
    rows["p"], rows["c"] = np.reshape(xyz, (-1, 3)), classes
    return bytes(head) + variable + rows.tobytes()


def variable(number: int, body: bytes) -> bytes:
    return struct.pack("<H16sHH32s", 0, b"LASF_Projection", number, len(body), b"") + body


def test_las_records(spark, tmp_path):
    """Files are split by records; both readers give the same points."""
    rng = np.random.default_rng(4)
    for i, n in enumerate((0, 7, 1000)):
        (tmp_path / f"{i}.las").write_bytes(las(rng.integers(-999, 999, (n, 3)), rng.integers(0, 31, n)))
    (tmp_path / "other.las").write_bytes(b"no points here")
    spark.dataSource.register(LasRecords)
    split = spark.read.format("las_records").option("path", f"{tmp_path}/*.las").option("records", 300).load()
    assert split.count() == 1007 and split.rdd.getNumPartitions() == 5
    whole = readers.read_las(spark, f"{tmp_path}/*.las", "2/7/12")
    same = split.filter("classification in (2, 7, 12)")
    assert sorted(map(tuple, same.select("x", "y", "z").collect())) == sorted(map(tuple, whole.select("x", "y", "z").collect()))


def test_las_srs(spark, tmp_path):
    keys = variable(34735, struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 26918))
    text = variable(2112, b'PROJCS["x"]\0')
    files = {"none": las([], []), "keys": las([], [], keys, 1), "text": las([], [], keys + text, 2), "cut": las([], [], b"", 3)}
    for name, raw in files.items():
        (tmp_path / f"{name}.las").write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[1][:-4]: r["srs"] for r in readers.las_srs(spark, f"{tmp_path}/*.las").collect()}
    assert got == {"none": None, "keys": "EPSG:26918", "text": 'PROJCS["x"]', "cut": None}
    assert reference_system(b"xxxx") is None
