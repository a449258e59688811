"""Readers and streams where they used to lose rows."""

import json
import struct

import numpy as np
import pytest

from pyspark.sql import functions as F

from test_parts import las, variable
from tidegrid import catalog_io
from tidegrid.functions.grid import GridSpec, Region
from tidegrid.functions.shared import stash
from tidegrid.sources import readers
from tidegrid.sources.las import LasRecords
from tidegrid.streaming import incremental

SMALL = "/root/testdata/sf0.001"


def test_offsets_come_before_scales(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("1 2 3\n")
    r = readers.read_xyz(spark, str(tmp_path / "a.xyz"), x_offset=10, x_scale=2, y_offset=-1, y_scale=5, z_scale=3).first()
    assert (r["x"], r["y"], r["z"]) == (22, 5, 9)


def test_rows_are_skipped_once_a_file_and_files_are_split(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.xyz").write_text("".join(f"{i} {k} 0\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 30_000)
    try:
        rows = readers.read_xyz(spark, str(tmp_path), skiprows=4)
        assert rows.rdd.getNumPartitions() > 3
        got = sorted((r["y"], r["x"]) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(float(k), float(i)) for k in range(3) for i in range(4, 20_000)]


def nested(depth):
    g = {"type": "Point", "coordinates": [1, 2, 3]}
    for _ in range(depth):
        g = {"type": "GeometryCollection", "geometries": [g]}
    return json.dumps({"type": "Feature", "properties": {}, "geometry": g}) + "\n"


def test_deep_collections_are_read_or_an_error(spark, tmp_path):
    for depth in (0, 5, 8):
        (tmp_path / f"{depth}.geojsonl").write_text(nested(depth))
        assert readers.read_geojson(spark, f"{tmp_path}/{depth}.geojsonl").count() == 1
    (tmp_path / "9.geojsonl").write_text(nested(9))
    with pytest.raises(Exception, match="deeper than 8"):
        readers.read_geojson(spark, f"{tmp_path}/9.geojsonl").collect()
    assert readers.read_geojson(spark, f"{tmp_path}/9.geojsonl", nesting=9).count() == 1


def test_layers_and_names_of_heights(spark, tmp_path):
    def write(name, *features):
        rows = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, 0]}, "properties": p} for i, p in enumerate(features)]
        (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        return f"{tmp_path}/{name}"

    path = write("a.geojsonl", {"layer": "COAST", "z": 1}, {"layer": "Mass_Point", "val": 2}, {"layer": "SurveyPoint", "Z_depth": 3}, {"z": 4})
    z = lambda **o: sorted(r["z"] for r in readers.read_geojson(spark, path, **o).collect())
    assert (z(), z(layers=()), z(layers=("COAST",))) == ([3], [1, 2, 3, 4], [1])
    path = write("b.geojsonl", {"layer": "COAST", "topography": 1}, {"z": 2, "height": 9})
    assert z() == [1, 2]


def test_reference_systems_far_from_the_header(spark, tmp_path):
    big = struct.pack("<H16sHH32s", 0, b"other", 7, 60_000, b"") + bytes(60_000)
    text = variable(2112, b'PROJCS["far"]\0')
    (tmp_path / "long.las").write_bytes(las([[1, 2, 3]], [2], big * 30 + text, 31))
    # version 1.4 with a record after the points
    body = b'GEOGCS["after"]\0'
    points = np.zeros(40, "u1").tobytes()
    head = bytearray(375)
    head[:4], head[24], head[25] = b"LASF", 1, 4
    struct.pack_into("<HII", head, 94, 375, 375, 0)
    struct.pack_into("<BHI", head, 104, 6, 30, 0)
    struct.pack_into("<QI", head, 235, 375 + len(points), 2)
    wide = lambda owner, n, b: struct.pack("<H16sHQ32s", 0, owner, n, len(b), b"") + b
    (tmp_path / "after.las").write_bytes(bytes(head) + points + wide(b"other", 1, b"zz") + wide(b"LASF_Projection", 2112, body))
    got = {r["path"].rsplit("/", 1)[1]: r["srs"] for r in readers.las_srs(spark, f"{tmp_path}/*.las").collect()}
    assert got == {"long.las": 'PROJCS["far"]', "after.las": 'GEOGCS["after"]'}


def test_a_short_las_file_is_an_error(spark, tmp_path):
    raw = las(np.zeros((9, 3)), np.zeros(9))
    (tmp_path / "a.las").write_bytes(raw[:-1])
    spark.dataSource.register(LasRecords)
    with pytest.raises(Exception, match="shorter than its header says"):
        spark.read.format("las_records").option("path", f"{tmp_path}/a.las").load().count()


def test_magic_numbers(spark, tmp_path):
    (tmp_path / "a.bag").write_bytes(b"\x89HDF\r\n" + bytes(100))
    (tmp_path / "b.bag").write_bytes(b"no")
    assert {r["path"][-5:]: r["valid"] for r in readers.reject_bag(spark, str(tmp_path)).collect()} == {"a.bag": True, "b.bag": False}


def test_streams_of_one_name_into_one_folder(spark, tmp_path):
    grid = GridSpec(Region(0, 4, 0, 4), 1.0, 1.0)
    schema = "seq long, dataset_id string, x double, y double, z double, w double, u double"
    for k in range(2):
        spark.createDataFrame([(k, "d", k + 0.5, 0.5, 7.0, 1.0, 0.0)], schema).write.parquet(f"{tmp_path}/in{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in{k}")
        incremental.ingest_stream(stream, grid, f"{tmp_path}/sums", f"{tmp_path}/progress{k}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/sums/batch=*").count() == 2
    # a query that goes on adds, and what it has is not folded in again
    spark.createDataFrame([(5, "d", 3.5, 3.5, 7.0, 1.0, 0.0)], schema).write.mode("append").parquet(f"{tmp_path}/in0")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in0")
    incremental.ingest_stream(stream, grid, f"{tmp_path}/sums", f"{tmp_path}/progress0").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/sums/batch=*").count() == 3


def test_lists_of_soundings_are_as_many_as_their_rows_need(spark, monkeypatch, tmp_path):
    whole = catalog_io.survey_beams(spark, SMALL)
    monkeypatch.setattr(catalog_io, "_LIST", 100)
    monkeypatch.setattr(catalog_io, "_place", lambda _, name: f"file://{tmp_path}/{name}")
    dealt = catalog_io.survey_beams(spark, SMALL)
    rows = [spark.read.text(str(p)).count() for p in tmp_path.glob("beams/lists/*/*.txt")]
    assert len(rows) > 16 and max(rows) < 1000 and sum(rows) == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert sorted(dealt.collect()) == sorted(whole.collect()) and dealt.count() > 100
    assert "SortMergeJoin" not in dealt._jdf.queryExecution().executedPlan().toString()


def test_lines_after_a_heading_stay_where_they_are_read(spark, monkeypatch, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.xyz").write_text("9;9;9\n8;8;8\n\n" + "".join(f"{i};{k};1\n" for k in range(400)))
    (tmp_path / "in/short.xyz").write_text("9;9;9\n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)  # several blocks a file
    try:
        rows = readers.read_xyz(spark, f"{tmp_path}/in", skiprows=3, delimiter=";")
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["x"], r["y"]) for r in rows.collect()) == [(i, k) for i in range(3) for k in range(400)]
        monkeypatch.setattr(catalog_io, "_place", lambda _, name: f"file://{tmp_path}/{name}")
        assert catalog_io.xyz_scaled(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()
        assert len(list(tmp_path.glob("scaled.xyz/*.txt"))) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_written_tables_leave_no_shuffle_files(spark):
    def files():
        held = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {held.apply(i).getName() for i in range(held.size()) if held.apply(i).getName().startswith("shuffle_")}

    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = spark.range(3000).groupBy((F.col("id") % 1000).alias("g")).count()
    written = stash(rows, "groups")
    assert files() <= before and written.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
