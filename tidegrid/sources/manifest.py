"""A folder of point files as one source: a manifest of files and their bounds, by which a region's files are chosen before any is opened.

A file's bounds are those of its sidecar, `<file>.inf`, a JSON object of min_x, max_x, min_y and max_y. Where that is missing it is made: all such files are
read once, together, and their tasks write the sidecars. The manifest is a table in the order of the Z-curve of the files' centres, so that files that lie together
share row groups, and a region's filters on w, e, s and n leave out the other groups.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegrid.functions.grid import Region
from tidegrid.sources.files import located, opened
from tidegrid.sources.readers import read_points
from tidegrid.sources.surveys import bounds_meet, crawl

#: fixed values: keys of a sidecar, and the columns of the manifest
KEYS = {"w": "min_x", "e": "max_x", "s": "min_y", "n": "max_y"}
_SCHEMA = "path string, w double, e double, s double, n double"


def _sidecar(path: str) -> tuple | None:
    """The bounds of a file's sidecar; None without one, or where it does not hold four numbers."""
    from pyarrow import fs

    system, place = located(f"{path}.inf")
    if system.get_file_info(place).type != fs.FileType.File:
        return None
    with opened(f"{path}.inf") as f:
        try:
            held = json.loads(f.read())
            return tuple(float(held[k]) for k in KEYS.values())
        except (ValueError, KeyError, TypeError):
            return None


def _batch(paths: list[str], bounds: list) -> pa.RecordBatch:
    columns = [pa.array([b[i] if b else None for b in bounds], pa.float64()) for i in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *columns], names=["path", *KEYS])


def _read(batches):
    for b in batches:
        paths = b.column(0).to_pylist()
        yield _batch(paths, [_sidecar(p) for p in paths])


def _write(batches):
    for b in batches:
        for row in b.to_pylist():
            system, place = located(f"{row['path']}.inf")
            with system.open_output_stream(place) as out:
                out.write(json.dumps({k: row[c] for c, k in KEYS.items()}).encode())
        yield b


def z_order(x: Column, y: Column, bits: int = 20) -> Column:
    """The place of (x, y), each from 0 to 1, on the Z-curve."""
    cell = lambda c: F.least(F.greatest(F.floor(c * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
    out = F.lit(0).cast("long")
    for i in range(bits):
        for c, shift in ((x, 2 * i), (y, 2 * i + 1)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(cell(c), i).bitwiseAND(F.lit(1).cast("long")), shift))
    return out


def build(spark: SparkSession, folder: str, extension: str, target: str, data_type: str | None = None, make: bool = True, **options) -> DataFrame:
    """Write the manifest (path, w, e, s, n, z) of a folder's files to `target`, and give it. Files without bounds are left out: without points, or, with
    `make` false, without sidecar. `options` go to the reader."""
    files = crawl(spark, folder, extension).select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = files.mapInArrow(_read, _SCHEMA)
    known.write.mode("overwrite").parquet(f"{target}/sidecars")
    known = spark.read.schema(_SCHEMA).parquet(f"{target}/sidecars")
    if make:
        missing = [r["path"] for r in known.filter("w IS NULL").select("path").collect()]  # paths of files to be read, as any read of files lists them
        if missing:
            rows = read_points(spark, missing, data_type or extension, **options).withColumn("path", F.input_file_name())
            bounds = rows.groupBy("path").agg(F.min("x").alias("w"), F.max("x").alias("e"), F.min("y").alias("s"), F.max("y").alias("n"))
            bounds.mapInArrow(_write, _SCHEMA).write.mode("overwrite").parquet(f"{target}/made")
            known = known.unionByName(spark.read.schema(_SCHEMA).parquet(f"{target}/made"))
    known = known.filter("w IS NOT NULL")
    whole = known.agg(F.min("w").alias("_w"), F.max("e").alias("_e"), F.min("s").alias("_s"), F.max("n").alias("_n"))  # one row
    part = lambda a, b, low, high: F.coalesce(F.try_divide((F.col(a) + F.col(b)) / 2 - F.col(low), F.col(high) - F.col(low)), F.lit(0.0))
    ordered = known.crossJoin(F.broadcast(whole)).withColumn("z", z_order(part("w", "e", "_w", "_e"), part("s", "n", "_s", "_n")))
    ordered.select("path", "w", "e", "s", "n", "z").repartitionByRange("z").sortWithinPartitions("z").write.mode("overwrite").parquet(f"{target}/files")
    return spark.read.parquet(f"{target}/files")


def meeting(manifest: DataFrame, region: Region) -> DataFrame:
    """(path) of the files whose bounds touch a region."""
    return manifest.filter(bounds_meet(region)).select("path")


def read_folder(manifest: DataFrame, region: Region, data_type: str, weight: float = 1.0, uncertainty: float = 0.0, **options) -> DataFrame:
    """The points, in the standard schema, of the files of a manifest that touch a region, with the `path` of each; other files are not opened."""
    spark = manifest.sparkSession
    paths = [r["path"] for r in meeting(manifest, region).collect()]
    if not paths:
        return spark.createDataFrame([], "x double, y double, z double, w double, u double, classification int, confidence smallint, path string")
    return read_points(spark, paths, data_type, weight, uncertainty, **options).withColumn("path", F.input_file_name())
