"""Surfaces against brute force and exact shapes; survey sources on small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.grid import GridSpec, Region
from tidegrid.operators import surfaces
from tidegrid.sources import readers, surveys

SCHEMA = "row int, col int, z double"


def table(spark, z):
    return spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)], SCHEMA)


def array(df, shape, name="z"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[name] is None else r[name]
    return out


def test_taxicab(spark):
    z = np.random.default_rng(1).random((9, 12))
    got = array(surfaces.taxicab(table(spark, z), F.col("z") > 0.9), z.shape, "distance")
    on = np.argwhere(z > 0.9)
    for (r, c), _ in np.ndenumerate(z):
        assert got[r, c] == min(abs(r - a) + abs(c - b) for a, b in on)
    assert np.isnan(array(surfaces.taxicab(table(spark, z), F.col("z") > 2), z.shape, "distance")).all()


@pytest.mark.parametrize("method, f", [("linear", lambda r, c: 2 * r - 3 * c + 1.0), ("cubic", lambda r, c: r**3 - 2.0 * c**3 + c * c)])
def test_interpolation_is_exact(spark, method, f):
    z = np.fromfunction(f, (10, 11))
    holes = z.copy()
    holes[4:6, 4:6] = np.nan
    assert array(surfaces.interp(table(spark, holes), method), z.shape) == pytest.approx(z)


def test_outside_stays_void_and_all_void(spark):
    z = np.full((3, 3), np.nan)
    assert np.isnan(array(surfaces.interp(table(spark, z)), z.shape)).all()
    z[1, 1] = 5
    got = array(surfaces.interp(table(spark, z), "cubic"), z.shape)
    assert np.nansum(got) == 5


def test_blends(spark):
    z = np.where(np.arange(12) < 6, 0.0, 10.0) * np.ones((8, 1))
    stack = table(spark, z).withColumn("weights", F.when(F.col("col") < 6, 2.0).otherwise(0.1))
    got = array(surfaces.ms_blend(stack, 1.0, 3, random_scale=0), z.shape)
    # the zone is columns 6 to 8: lines give 2.5, 5, 7.5; the distances 1 to 3 scale to 0, 0.5, 1
    assert got == pytest.approx(np.tile([0] * 6 + [2.5, 7.5, 10, 10, 10, 10], (8, 1)))
    same = array(surfaces.ms_blend(stack.withColumn("weights", F.lit(0.0)), 1.0, 3), z.shape)
    assert (same == z).all()
    aux = table(spark, np.full((8, 12), 10.0)).filter("col BETWEEN 4 AND 7 AND row BETWEEN 2 AND 5")
    flat = table(spark, np.zeros((8, 12)))
    got = array(surfaces.raster_blend(flat, aux, 1, random_scale=0), z.shape)
    assert got[0, 0] == 0 and got[3, 5] == 10 and got.max() <= 10
    again = [array(surfaces.raster_blend(flat, aux, 3, random_scale=0.5, slope_scale=0), z.shape) for _ in range(2)]
    assert (again[0] == again[1]).all()


def test_cudem_of_a_constant(spark):
    z = np.full((18, 18), 7.0)
    z[3:12, 3:12] = np.nan
    stack = table(spark, z).withColumn("count", F.lit(1)).withColumn("weights", F.lit(1.0))
    assert array(surfaces.ms_cudem(stack), z.shape) == pytest.approx(np.full((18, 18), 7.0))


def test_polygons(spark):
    z = np.array([[1, 0, 1, 1], [1, 1, 0, 1], [0, 0, 0, 0], [1, 0, 1, 1]], float)
    grid = GridSpec(Region(0, 4, 0, 4), 1.0, 1.0)
    got = sorted((r["n_cells"], r["n_sides"], r["w"], r["e"], r["s"], r["n"]) for r in surfaces.polygons(table(spark, z), F.col("z") == 1, grid).collect())
    assert got == [(1, 4, 0, 1, 0, 1), (2, 6, 2, 4, 0, 1), (3, 8, 0, 2, 2, 4), (3, 8, 2, 4, 2, 4)]
    edges = surfaces.outlines(table(spark, z), F.col("z") == 1, grid).collect()
    assert len(edges) == 26
    for label in {e["label"] for e in edges}:
        own = [e for e in edges if e["label"] == label]
        assert sorted((e["x1"], e["y1"]) for e in own) == sorted((e["x2"], e["y2"]) for e in own)
        area = sum(e["x1"] * e["y2"] - e["x2"] * e["y1"] for e in own) / 2
        assert area == len([1 for p in surfaces.label_cells(table(spark, z), F.col("z") == 1).collect() if p["label"] == label])
    assert surfaces.polygons(table(spark, z), F.col("z") > 5, grid).count() == 0


def test_beams_and_metadata(spark, tmp_path):
    beam = dict.fromkeys(surveys.BEAM_COLUMNS, 0.0) | {"x": 1.0, "y": 2.0, "z": -10.0, "speed": 14.0, "seafloor_grazing_angle": 30.0}
    rows = [beam, beam | {"beamflag": 1.0}]
    (tmp_path / "a.txt").write_text("\n".join("\t".join(str(r[c]) for c in surveys.BEAM_COLUMNS) for r in rows) + "\n")
    all_rows, good = (surveys.read_beams(spark, str(tmp_path / "a.txt"), 2002, f) for f in (False, True))
    assert (all_rows.count(), good.count()) == (2, 1)
    r = good.first()
    assert r["u"] == pytest.approx(0.51 * 0.45) and r["w"] == pytest.approx(0.5 / r["u"])
    (tmp_path / "a.inf").write_text("MBIO Data Format ID:  58\nTime:  06 11 2009 10:00\nNumber of Good Beams:  900  90.50%\n")
    got = surveys.read_beam_metadata(spark, str(tmp_path / "a.inf")).first()
    assert (got["format"], got["year"], got["good_percent"]) == ("58", 2009, 90.5)


def test_crawl_ids_and_weights(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("a.xyz", "d/b.xyz", "c.csv"):
        (tmp_path / n).write_text("1 2 3\n")
    assert surveys.crawl(spark, str(tmp_path), "xyz").count() == 2
    rows = [("s", "u", "n", 1), (None, "https://x/y", "n", 1), (None, "file:///x", "n", 5), (None, None, "n", None)]
    df = spark.createDataFrame(rows, "checksum string, url string, name string, size long")
    assert [r[0] for r in df.select(surveys.dataset_id()).collect()] == ["s", "https://x/y", "n|5B", "n"]
    one = spark.range(1)
    assert [one.select(surveys.gridded_weight(r, 0.1)).first()[0] for r in (0, 2, 6, 60)] == [1.0, 15.0, 0.5, 0.1]
    b = spark.createDataFrame([(0.0, 1.0, 0.0, 1.0), (5.0, 6.0, 0.0, 1.0)], "w double, e double, s double, n double")
    assert b.filter(surveys.bounds_meet(Region(1, 2, 0, 1))).count() == 1


def test_header_of_one_row(spark, tmp_path):
    f = tmp_path / "h.csv"
    f.write_text('a,b,c\n"1",2,3\n1,2,3\n')
    assert readers.read_xyz(spark, str(f), skiprows=1, delimiter=",").count() == 1
    (tmp_path / "h2.csv").write_text("a\nb\n1,2,3\n")
    assert readers.read_xyz(spark, str(tmp_path / "h2.csv"), skiprows=2).count() == 1
