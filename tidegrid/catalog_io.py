"""Registered queries of readers, writers, incremental stacks and reprojection: each writes to the shared folder, reads back, and has the SQL
of what must come back."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegrid.functions.grid import Region
from tidegrid.functions.shared import shared_dir
from tidegrid.operators import filters, stacks
from tidegrid.plans.fixtures import GRID, beams, datasets, points, reference, with_sql
from tidegrid.sources import manifest, readers, surveys, tiff
from tidegrid.streaming import incremental


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidegrid/{uuid.uuid4().hex}-{name}"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def xyz_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """ASCII lines, read in the standard schema with a weight and an uncertainty of the source."""
    place = _place(spark, "points.xyz")
    readers.write_xyz(points(spark, sf), place)
    return _rounded(readers.read_points(spark, place, weight=2.0, uncertainty=0.5, wpos=3, upos=4).select("x", "y", "z", "w", "u"))


def xyz_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Comma-separated soundings with a header, latitude first and depth down."""
    place = _place(spark, "soundings.csv")
    points(spark, sf).select("seq", F.col("y").alias("lat"), F.col("x").alias("lon"), F.round("z", 6).alias("depth")).write.csv(place, header=True)
    return _rounded(readers.read_points(spark, place, "nos_xyz").select("x", "y", "z", "w", "u"))


def xyz_scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Lines after three rows of heading in each file, moved and scaled."""
    place = _place(spark, "scaled.xyz")
    lines = points(spark, sf).select(F.concat_ws(";", F.round("x", 6), F.round("y", 6), F.round("z", 6)).alias("value"))
    lines.mapInArrow(_headed, "value string").write.text(place)
    rows = readers.read_points(spark, place, "xyz", skiprows=3, delimiter=";", x_offset=2.0, x_scale=10.0, y_offset=-1.0, y_scale=2.0, z_scale=-2.0)
    return _rounded(rows.select("x", "y", "z", "w", "u"))


def _headed(batches):
    """Three rows of heading before the lines of a task, which are those of a file."""
    import pyarrow as pa

    yield pa.RecordBatch.from_pydict({"value": pa.array(["9;9;9", "8;8;8", "7;7;7"])})
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0)], names=["value"])


def ogr_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Features of several layers, of which the first known one is read, with heights in a property of a known name and nested collections."""
    place = _place(spark, "layers.geojsonl")
    name = F.when(F.col("seq") % 3 == 0, "SurveyPoint").when(F.col("seq") % 3 == 1, "Mass_Point").otherwise("LNDARE")
    inner = F.format_string('{"type": "Point", "coordinates": [%s, %s]}', F.col("x").cast("string"), F.col("y").cast("string"))
    for _ in range(5):
        inner = F.concat(F.lit('{"type": "GeometryCollection", "geometries": ['), inner, F.lit("]}"))
    feature = F.concat(F.lit('{"type": "Feature", "geometry": '), inner, F.lit(', "properties": '), F.to_json(F.struct(name.alias("layer"), F.round("z", 6).alias("surveyPointElev"))), F.lit("}"))
    points(spark, sf).select(feature.alias("value")).write.text(place)
    return _rounded(readers.read_points(spark, place).select("x", "y", "z"))


def folder_region(spark: SparkSession, sf: str) -> DataFrame:
    """The points of those files of a folder whose bounds touch a region, and how many files that are: a file a tile, and no other is opened."""
    place = _place(spark, "folder")
    tile = F.concat_ws("_", F.floor(F.col("x") / 2).cast("int"), F.floor(F.col("y") / 2).cast("int")).alias("tile")
    line = F.concat_ws(" ", *[F.round(c, 6) for c in "xyz"]).alias("value")
    points(spark, sf).select(line, tile).repartition("tile").write.partitionBy("tile").text(place)
    files = manifest.build(spark, place, "txt", f"{place}-manifest", "xyz")
    rows = manifest.read_folder(files, Region(5.1, 7.9, 3.3, 8.2), "xyz")
    n = rows.agg(F.count_distinct("path").alias("files"))  # one row
    return _rounded(rows.select("x", "y", "z").crossJoin(F.broadcast(n)))


def profile_csb(spark: SparkSession, sf: str) -> DataFrame:
    """Comma-separated soundings with a header, longitude first."""
    place = _place(spark, "crowd.csv")
    points(spark, sf).select(*[F.round(c, 6).alias(c) for c in "xyz"]).write.csv(place, header=True)
    return _rounded(readers.read_points(spark, place, "csb_csv").select("x", "y", "z", "w", "u"))


def profile_charts(spark: SparkSession, sf: str) -> DataFrame:
    """The sounding layer of a chart, depths down."""
    place = _place(spark, "chart.geojsonl")
    name = F.when(F.col("seq") % 4 == 0, "LNDARE").otherwise("SOUNDG")
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y", F.round("z", 6)).alias("coordinates")).alias("geometry")
    points(spark, sf).select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry, F.struct(name.alias("layer")).alias("properties"))).alias("value")).write.text(place)
    return _rounded(readers.read_points(spark, place, "charts_000").select("x", "y", "z", "w", "u"))


def tiff_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Points of a grid file by its bands of mask, weight and uncertainty."""
    place = _place(spark, "bands")
    cells = GRID.index(points(spark, sf)).groupBy("row", "col").agg(
        F.max("z").alias("z"), (F.max("seq") % 3).cast("double").alias("mask"), F.max("w").alias("weight"), F.max("u").alias("unc")
    )
    bands = ("z", "mask", "weight", "unc")
    tiff.write_grid(cells, place, GRID, bands, block=32, tile=16)
    return _rounded(readers.cells_to_points(tiff.read_grid(spark, place, bands, GRID), GRID, "weight", "unc", "mask"))


def footprint_features(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of every dataset as features, read back corner by corner."""
    place = _place(spark, "footprints.geojsonl")
    readers.write_footprints(stacks.footprints(points(spark, sf), Region(0, 16, 0, 16)), place, ("dataset_id",))
    rows = spark.read.text(place).select(F.get_json_object("value", "$.properties.dataset_id").alias("dataset_id"), F.from_json(F.get_json_object("value", "$.geometry.coordinates"), "array<array<array<double>>>").alias("c"))
    return rows.select("dataset_id", F.posexplode(F.col("c")[0]).alias("corner", "p")).select("dataset_id", "corner", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def sidecar_polygon(spark: SparkSession, sf: str) -> DataFrame:
    """The bounding polygon of every dataset as text, whole."""
    return stacks.stream_inf(points(spark, sf)).select("dataset_id", stacks.bounds_wkt().alias("wkt"))


def dataset_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Identities of datasets by checksum, remote address, or name and size."""
    kind = F.col("seq") % 4
    rows = points(spark, sf).select(
        "seq", F.when(kind == 0, F.concat(F.lit("sum"), "seq")).alias("checksum"), F.when(kind == 1, F.concat(F.lit("https://x/"), "seq")).when(kind == 2, F.concat(F.lit("file:///x/"), "seq")).alias("url"),
        F.concat(F.lit("n"), "seq").alias("name"), F.when(kind == 2, F.col("seq") * 10).alias("size"),
    )
    return rows.select("seq", surveys.dataset_id().alias("id"))


def gridded_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of gridded surveys by their cell size."""
    return points(spark, sf).select("seq", F.round(surveys.gridded_weight(F.col("w") * 2 - 2 + F.col("u"), 0.75), 6).alias("weight"))


#: Years of the lists of soundings, and soundings that such a list holds about.
_YEARS, _LIST = 8, 250_000


def survey_beams(spark: SparkSession, sf: str) -> DataFrame:
    """Soundings of the lists whose metadata name a late enough year, within a region, with weights by age."""
    place = _place(spark, "beams")
    b = beams(spark, sf).withColumn("x", (F.col("l_orderkey") % 997).cast("double")).withColumn("y", F.col("l_linenumber").cast("double"))
    b = b.withColumn("year", (F.col("l_orderkey") % 8 * 5 + 1985).cast("int"))
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).cast("string") if c in b.columns else F.lit("0.0") for c in surveys.BEAM_COLUMNS])
    lists = 1 + b.count() // (_YEARS * _LIST)  # of each year
    dealt = b.select(line.alias("value"), "year", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(lists)).alias("list")).repartition(_YEARS * lists, "year", "list")
    dealt.select("value", "year").write.partitionBy("year").text(f"{place}/lists")
    files = spark.read.text(f"{place}/lists").select(F.input_file_name().alias("path")).distinct()
    lines = F.concat(F.lit("MBIO Data Format ID:  58\nTime:  06 11 "), F.regexp_extract("path", r"year=(\d+)", 1), F.lit(" 10:00\nNumber of Good Beams:  900  90.50%\n"))
    files.select("path", lines.alias("text")).mapInArrow(_beside, "n int").count()
    chosen = surveys.select_surveys(surveys.read_beam_metadata(spark, f"{place}/lists/*/*.inf"), min_year=2000)
    rows = surveys.read_surveys(spark, chosen, region=Region(100, 700, 1, 3))
    return rows.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "z", F.round("u", 6).alias("u"), F.round("w", 6).alias("w"))


def _beside(batches):
    """Write a file of metadata beside each list (path, text)."""
    import pyarrow as pa

    from tidegrid.sources.files import located

    for b in batches:
        for row in b.to_pylist():
            system, path = located(row["path"].removesuffix(".txt") + ".inf")
            with system.open_output_stream(path) as out:
                out.write(row["text"].encode())
        yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int32())})


def columnar_binned(spark: SparkSession, sf: str) -> DataFrame:
    """A columnar file of one point a cell."""
    place = _place(spark, "points.gtpc")
    readers.write_columnar(points(spark, sf), place, GRID)
    return _rounded(readers.read_points(spark, place).select("x", "y", "z", F.col("w").alias("weight"), F.col("u").alias("uncertainty")))


def geojson_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Features by line, with elevation, weight and uncertainty in their properties."""
    place = _place(spark, "features.geojsonl")
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry")
    properties = F.struct(F.round("z", 6).alias("Depth"), F.col("w").alias("wt"), F.col("u").alias("err")).alias("properties")
    points(spark, sf).select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry, properties)).alias("value")).write.text(place)
    return _rounded(readers.read_points(spark, place, weight_field="wt", uncertainty_field="err", z_scale=-1.0).select("x", "y", "z", "w", "u"))


def sidecar_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of every dataset with its bounding polygon, as JSON lines."""
    place = _place(spark, "sidecars.json")
    readers.write_sidecars(stacks.stream_inf(points(spark, sf)).withColumn("wkt", stacks.bounds_wkt()), place)
    back = spark.read.schema("dataset_id string, numpts long, xmin double, xmax double, ymin double, ymax double, wkt string").json(place)
    return back.select("dataset_id", "numpts", "xmin", "xmax", "ymin", "ymax", F.col("wkt").startswith("POLYGON ((").alias("has_polygon"))


def binned_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Cells as lines of row, col and z."""
    place = _place(spark, "cells.txt")
    readers.write_xyz(stacks.simple_stack(points(spark, sf), GRID), place, 4, ",", ("row", "col", "z"))
    return spark.read.schema("row int, col int, z double").csv(place).select("row", "col", F.round("z", 3).alias("z"))


_PART = Region(3.5, 20.0, 2.0, 9.5)


def cells_window(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of a columnar grid that a region meets."""
    place = _place(spark, "cells.parquet")
    stacks.simple_stack(points(spark, sf), GRID).write.parquet(place)
    return _rounded(readers.read_cells(spark, place, GRID, _PART))


def survey_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of gridded surveys by their names."""
    datum = F.when(F.col("seq") % 3 == 0, "Ellipsoid").otherwise("MLLW")
    return surveys.gridded_surveys(points(spark, sf).select("seq", F.format_string("%s_%d_%s_2of5.bag", F.col("dataset_id"), F.col("seq"), datum).alias("path")))


def incremental_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A stack of three batches that share datasets, one of which is run twice."""
    place, p = _place(spark, "sums"), points(spark, sf)
    for part in (0, 1, 2, 1):
        incremental.ingest_batch(p.filter(F.col("seq") % 3 == part), GRID, place, f"b{part}")
    return _rounded(incremental.current(spark, place, datasets(spark)))


def streamed_stack(spark: SparkSession, sf: str) -> DataFrame:
    """The same by Structured Streaming, a file a micro-batch, with a tap that counts points."""
    landing, sums, counts = _place(spark, "landing"), _place(spark, "sums"), _place(spark, "counts")
    p = points(spark, sf)
    p.repartition(3, "seq").write.parquet(landing)
    tap = lambda batch, number: batch.groupBy().agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{counts}/batch={number}")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    incremental.ingest_stream(stream, GRID, sums, _place(spark, "progress"), taps=[tap]).awaitTermination()
    seen = spark.read.parquet(counts).agg(F.sum("n").alias("points_seen"))
    return _rounded(incremental.current(spark, sums, datasets(spark)).crossJoin(F.broadcast(seen)))  # one row


def reproject_mercator(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees to metres."""
    moved = filters.reproject(points(spark, sf), "mercator")
    return moved.select("seq", *[(F.round(c, 3) + 0.0).alias(c) for c in "xy"])  # no negative zero


def reproject_utm(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of degrees, read into zone 32 of UTM; back in degrees no point has moved."""
    place = _place(spark, "degrees.xyz")
    p = points(spark, sf).select("x", "y", F.col("seq").cast("double").alias("z"))
    readers.write_xyz(p, place, 9, columns=("x", "y", "z"))
    moved = readers.read_points(spark, place, src_srs="EPSG:4326", dst_srs="EPSG:32632")
    back = filters.reproject(moved.withColumns({"px": F.col("x"), "py": F.col("y")}), "geographic", "EPSG:32632")
    near = back.join(p.select("z", F.col("x").alias("ox"), F.col("y").alias("oy")), "z")
    still = (F.abs(F.col("x") - F.col("ox")) < 1e-8) & (F.abs(F.col("y") - F.col("oy")) < 1e-8)
    return near.select(F.col("z").cast("long").alias("seq"), F.round("px", 2).alias("x"), F.round("py", 2).alias("y"), still.alias("still"))


def reproject_shifted(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees to metres, with heights moved by a grid; back to degrees no point has moved by more than a millionth."""
    moved = filters.reproject(points(spark, sf), "mercator", shift=reference(spark, sf), grid=GRID, value="ref_z")
    back = filters.reproject(moved.select("seq", F.col("x").alias("mx"), F.col("y").alias("my"), "x", "y", "z"), "geographic", "mercator")
    near = points(spark, sf).select("seq", F.col("x").alias("px"), F.col("y").alias("py")).join(back, "seq")
    still = (F.abs(F.col("px") - F.col("x")) < 1e-6) & (F.abs(F.col("py") - F.col("y")) < 1e-6)
    return near.select("seq", (F.round("mx", 3) + 0.0).alias("x"), (F.round("my", 3) + 0.0).alias("y"), F.round("z", 3).alias("z"), still.alias("still"))


def provenance_legend(spark: SparkSession, sf: str) -> DataFrame:
    """The bit of every module that a dataset of the points belongs to."""
    return stacks.provenance_legend(datasets(spark).join(points(spark, sf).select("dataset_id").distinct(), "dataset_id", "left_semi"))


_SIDES = 2000


def vector_mask_coast(spark: SparkSession, sf: str) -> DataFrame:
    """A polygon of two thousand sides with a hole."""
    turn = [2 * math.pi * i / _SIDES for i in range(_SIDES)]
    ring = lambda r: [(8 + (r + math.cos(40 * t)) * math.cos(t), 8 + (r + math.cos(40 * t)) * math.sin(t)) for t in turn]
    return filters.vector_mask(points(spark, sf), [[ring(6), ring(2)]]).select("seq", "classification")


_COAST = f""", v AS (SELECT r.r AS ring, i, 8 + (r.r + cos(40 * t)) * cos(t) AS x, 8 + (r.r + cos(40 * t)) * sin(t) AS y
    FROM (VALUES (6), (2)) r(r), (SELECT i, 2 * pi() * i / {_SIDES} AS t FROM range({_SIDES}) s(i))),
  e AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.ring = b.ring AND b.i = (a.i + 1) % {_SIDES}),
  c AS (SELECT seq, count(*) AS n FROM p JOIN e ON (y1 > p.y) <> (y2 > p.y) AND p.x < (x2 - x1) * (p.y - y1) / (y2 - y1) + x1 GROUP BY seq)
SELECT p.seq, CASE WHEN coalesce(n, 0) % 2 = 1 THEN 7 ELSE classification END AS classification FROM p LEFT JOIN c USING (seq)"""

_N = 1 / 298.257223563 / (2 - 1 / 298.257223563)
#: Zone 32 by Kruger's series to the fourth order.
_UTM = f""", c AS (SELECT {_N} AS n, 2*sqrt({_N})/(1 + {_N}) AS e),
  k AS (SELECT e, 6378137.0/(1 + n)*(1 + n**2/4 + n**4/64) AS a, n/2 - 2*n**2/3 + 5*n**3/16 + 41*n**4/180 AS a1, 13*n**2/48 - 3*n**3/5 + 557*n**4/1440 AS a2, 61*n**3/240 - 103*n**4/140 AS a3, 49561*n**4/161280 AS a4 FROM c),
  t AS (SELECT seq, radians(x - 9) AS l, sinh(atanh(sin(radians(y))) - e*atanh(e*sin(radians(y)))) AS t, k.* FROM p, k),
  u AS (SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l)/sqrt(1 + t*t)) AS eta FROM t)
  SELECT seq, round(500000 + 0.9996*a*(eta + a1*cos(2*xi)*sinh(2*eta) + a2*cos(4*xi)*sinh(4*eta) + a3*cos(6*xi)*sinh(6*eta) + a4*cos(8*xi)*sinh(8*eta)), 2) AS x,
    round(0.9996*a*(xi + a1*sin(2*xi)*cosh(2*eta) + a2*sin(4*xi)*cosh(4*eta) + a3*sin(6*xi)*cosh(6*eta) + a4*sin(8*xi)*cosh(8*eta)), 2) AS y, true AS still FROM u"""

_POINT = "SELECT round(x, 6) AS x, round(y, 6) AS y, round({z}, 6) AS z, {w} AS w, round({u}, 6) AS u FROM p"


def queries() -> dict:
    own = (
        xyz_round_trip, xyz_profile, xyz_scaled, ogr_layers, folder_region, profile_csb, profile_charts, tiff_bands, footprint_features, sidecar_polygon,
        dataset_ids, gridded_weights, survey_beams, columnar_binned, geojson_fields, sidecar_round_trip, binned_lines, incremental_batches, streamed_stack,
        reproject_mercator, reproject_utm, reproject_shifted, provenance_legend, vector_mask_coast, cells_window, survey_files,
    )
    return {f.__name__: f for f in own}


def oracle_sql(known: dict[str, str]) -> dict[str, str]:
    """SQL of these queries; `known`: that of the others, some of which must give the same."""
    mean = known["multi_stack_mean"]
    return {
        "xyz_round_trip": with_sql("p", _POINT.format(z="z", w="w * 2", u="sqrt(u * u + 0.25)")),
        "xyz_profile": with_sql("p", _POINT.format(z="-z", w="1.0::DOUBLE", u="0.0::DOUBLE")),
        "xyz_scaled": with_sql("p", "SELECT round((round(x, 6) + 2) * 10, 6) AS x, round((round(y, 6) - 1) * 2, 6) AS y, round(round(z, 6) * -2, 6) AS z, 1.0::DOUBLE AS w, 0.0::DOUBLE AS u FROM p"),
        "ogr_layers": with_sql("p", "SELECT x, y, round(z, 6) AS z FROM p WHERE seq % 3 = 0"),
        "folder_region": with_sql(
            "p",
            """, t AS (SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, floor(x / 2) AS i, floor(y / 2) AS j FROM p),
            b AS (SELECT i, j FROM t GROUP BY i, j HAVING max(x) >= 5.1 AND min(x) <= 7.9 AND max(y) >= 3.3 AND min(y) <= 8.2)
            SELECT x, y, z, (SELECT count(*) FROM b) AS files FROM t JOIN b USING (i, j)""",
        ),
        "profile_csb": with_sql("p", _POINT.format(z="z", w="1.0::DOUBLE", u="0.0::DOUBLE")),
        "profile_charts": with_sql("p", _POINT.format(z="-z", w="1.0::DOUBLE", u="0.0::DOUBLE") + " WHERE seq % 4 <> 0"),
        "tiff_bands": with_sql("p g", "SELECT col + 0.5::DOUBLE AS x, 15.5::DOUBLE - row AS y, round(max(z), 6) AS z, max(w) AS w, max(u) AS u FROM g GROUP BY row, col HAVING max(seq) % 3 <> 0"),
        "footprint_features": with_sql("p", """, b AS (SELECT dataset_id, min(x) AS w, max(x) AS e, min(y) AS s, max(y) AS n FROM p GROUP BY dataset_id)
          SELECT dataset_id, CAST(k AS INT) AS corner, CASE WHEN k IN (1, 2) THEN e ELSE w END AS x, CASE WHEN k IN (2, 3) THEN n ELSE s END AS y FROM b, range(5) t(k)"""),
        "sidecar_polygon": with_sql("p", """, b AS (SELECT dataset_id, min(x) AS w, max(x) AS e, min(y) AS s, max(y) AS n FROM p GROUP BY dataset_id),
          t AS (SELECT dataset_id, list_transform([w, e, s, n], lambda v: regexp_replace(regexp_replace(printf('%.6f', v), '0+$', ''), '\\.$', '')) AS v FROM b)
          SELECT dataset_id, 'POLYGON ((' || v[1] || ' ' || v[3] || ', ' || v[1] || ' ' || v[4] || ', ' || v[2] || ' ' || v[4] || ', ' || v[2] || ' ' || v[3] || ', ' || v[1] || ' ' || v[3] || '))' AS wkt FROM t"""),
        "dataset_ids": with_sql("p", "SELECT seq, CASE seq % 4 WHEN 0 THEN 'sum' || seq WHEN 1 THEN 'https://x/' || seq WHEN 2 THEN 'n' || seq || '|' || seq*10 || 'B' ELSE 'n' || seq END AS id FROM p"),
        "gridded_weights": with_sql("p", "SELECT seq, round(CASE WHEN r = 0 THEN 1 ELSE greatest(3 * CASE WHEN r <= 3 THEN 10 ELSE 1 END / r, 0.75) END, 6) AS weight FROM (SELECT seq, w * 2 - 2 + u AS r FROM p)"),
        "survey_beams": with_sql("b", """, q AS (SELECT *, l_orderkey % 997 AS px, l_linenumber AS py, l_orderkey % 8 * 5 + 1985 AS year,
            sqrt(pow(0.51*(0.25 + 0.02*abs(z)), 2) + pow(0.005*abs(crosstrack_distance), 2) + pow(0.51*least(14.0, abs(speed - 14)), 2)) AS v FROM b)
          SELECT CAST(px AS INT) AS x, CAST(py AS INT) AS y, z, round(v, 6) AS u, round(1/v * least(0.99, greatest(0.01, 1 - (2024 - year)/44)), 6) AS w
          FROM q WHERE year >= 2000 AND px BETWEEN 100 AND 700 AND py BETWEEN 1 AND 3"""),
        "columnar_binned": with_sql("p g", "SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(min_by(w, seq) * count(*), 6) AS weight, round(sqrt(pow(min_by(u, seq), 2) + pow(stddev_pop(z), 2)), 6) AS uncertainty FROM g GROUP BY row, col"),
        "geojson_fields": with_sql("p", _POINT.format(z="-z", w="w", u="u")),
        "sidecar_round_trip": with_sql("p", "SELECT dataset_id, count(*) AS numpts, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, true AS has_polygon FROM p GROUP BY 1"),
        "binned_lines": with_sql("p g", "SELECT row, col, round(round(sum(z * w) / sum(w), 4), 3) AS z FROM g GROUP BY row, col"),
        "cells_window": with_sql("p g", "SELECT row, col, round(sum(z*w)/sum(w), 6) AS z FROM g WHERE row BETWEEN 6 AND 13 AND col BETWEEN 3 AND 15 GROUP BY row, col"),
        "survey_files": with_sql("p", "SELECT seq, dataset_id || '_' || seq || '_MLLW_2of5.bag' AS path FROM p WHERE seq % 3 <> 0"),
        "incremental_batches": mean,
        "streamed_stack": f"SELECT m.*, s.points_seen FROM ({mean}) m, (SELECT count(*) AS points_seen FROM orders) s",
        "reproject_mercator": with_sql("p", "SELECT seq, round(radians(x) * 6378137.0, 3) + 0.0 AS x, round(ln(tan(radians(y) / 2 + pi() / 4)) * 6378137.0, 3) + 0.0 AS y FROM p"),
        "reproject_utm": with_sql("p", _UTM),
        "reproject_shifted": with_sql(
            "p ref",
            """, a AS (SELECT seq, floor(x - 0.5) AS c, floor(16 - y - 0.5) AS r, x - 0.5 - floor(x - 0.5) AS a, 16 - y - 0.5 - floor(16 - y - 0.5) AS b FROM p),
            f AS (SELECT seq, r + dr AS row, c + dc AS col, (CASE dr WHEN 1 THEN b ELSE 1 - b END) * (CASE dc WHEN 1 THEN a ELSE 1 - a END) AS w
              FROM a, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(dr, dc)),
            s AS (SELECT seq, CASE WHEN count(ref_z) = count(*) THEN sum(w * ref_z) END AS shift FROM f LEFT JOIN ref USING (row, col) WHERE w > 1e-7 GROUP BY seq)
            SELECT seq, round(radians(x) * 6378137.0, 3) + 0.0 AS x, round(ln(tan(radians(y) / 2 + pi() / 4)) * 6378137.0, 3) + 0.0 AS y, round(z + shift, 3) AS z, true AS still FROM p JOIN s USING (seq)""",
        ),
        "provenance_legend": with_sql(
            "p ds",
            """, m AS (SELECT module, min(ingest_order) AS first FROM ds WHERE dataset_id IN (SELECT dataset_id FROM p) GROUP BY module),
            b AS (SELECT module, CAST(row_number() OVER (ORDER BY first, module) - 1 AS INT) AS bit FROM m) SELECT module, bit, 1::BIGINT << bit AS value FROM b""",
        ),
        "vector_mask_coast": with_sql("p", _COAST),
    }
