"""Readers to the standard point schema: ASCII, GeoJSON vertices, LAS records, grids, columnar files."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegrid.functions.grid import GridSpec, Region, ensure_schema, projected
from tidegrid.sources.files import opened
from tidegrid.sources.las import HEADER, Layout, reference_system_of

#: fixed values: option presets by data type
PROFILES = {
    "nos_xyz": {"delimiter": ",", "skiprows": 1, "xpos": 2, "ypos": 1, "zpos": 3, "z_scale": -1.0},
    "csb_csv": {"delimiter": ",", "skiprows": 1, "xpos": 0, "ypos": 1, "zpos": 2},
}
#: fixed values: option presets of vector data types
VECTOR_PROFILES = {"charts_000": {"z_scale": -1.0, "layers": ("SOUNDG",)}}
#: fixed values: reader by file extension
EXTENSIONS = {
    "xyz": "xyz", "txt": "xyz", "csv": "xyz", "dat": "xyz", "json": "geojson", "geojson": "geojson", "geojsonl": "geojson", "las": "las", "gtpc": "columnar", "parquet": "columnar",
}


def read_xyz(
    spark: SparkSession, path, xpos: int = 0, ypos: int = 1, zpos: int = 2, wpos: int | None = None, upos: int | None = None,
    skiprows: int = 0, delimiter: str | None = None, z_scale: float = 1.0, x_offset: float = 0.0, y_offset: float = 0.0,
    x_scale: float = 1.0, y_scale: float = 1.0,
) -> DataFrame:
    """ASCII points; x and y are moved by their offsets, then scaled. Lines that begin with # and lines whose coordinates are no numbers are left
    out; without a delimiter commas, semicolons, bars and white space part fields. Files are split among tasks, whatever is skipped: one row is
    read as a header, and of more the last one's number within the first block of each file is looked up."""
    text = spark.read.text(path)
    if skiprows == 1:
        # a separator that no line has, and no quotes: a line is one value
        text = spark.read.csv(path, schema="value string", header=True, sep="\x01", quote="", enforceSchema=True).filter("value IS NOT NULL")
    elif skiprows:
        placed = text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
        # a row for each file; numbers of a block follow one another
        head = placed.filter("_block = 0").groupBy("_file").agg((F.min("_line") + (skiprows - 1)).alias("_last"))
        text = placed.join(F.broadcast(head), "_file", "left").filter("_block > 0 OR _line > _last").select("value")
    line = F.trim("value")
    fields = F.split(line, r"[,;|\s]+" if delimiter is None else "\\" + delimiter if delimiter in "|.+*?^$()[]{}\\" else delimiter)
    at = lambda i: F.get(fields, F.lit(i)).try_cast("double")
    rows = text.filter((F.length(line) > 0) & ~line.startswith("#"))
    out = rows.select(
        ((at(xpos) + x_offset) * x_scale).alias("x"), ((at(ypos) + y_offset) * y_scale).alias("y"), (at(zpos) * z_scale).alias("z"),
        (at(wpos) if wpos is not None else F.lit(1.0)).alias("w"), (at(upos) if upos is not None else F.lit(0.0)).alias("u"),
    )
    return out.filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


#: fixed values: property names that hold an elevation, in the order in which they are tried
Z_FIELDS = ("Elevation", "elev", "z", "height", "depth", "val", "value", "topography", "surveyPointElev", "Z_depth", "Z_height")
#: fixed values: names of layers that hold soundings, in the order in which they are tried
LAYERS = ("SOUNDG", "SurveyPoint_HD", "SurveyPoint", "Mass_Point", "Spot_Elevation")


def vertices(
    features: DataFrame, elevation: float | None = None, z_field: str | None = None, weight_field: str | None = None,
    uncertainty_field: str | None = None, z_scale: float = 1.0,
) -> DataFrame:
    """Vertices of GeoJSON geometries (columns geometry and properties as JSON strings): z of the vertex, else of the feature's
    `z_field` (if None: the first of `Z_FIELDS`, in any case of letters, that is a number), else the constant, times `z_scale`; vertices with
    none are left out. w and u are the feature's fields, else 1 and 0. Coordinates may be nested to any of the standard depths."""
    held = F.from_json("properties", "map<string,string>")
    held = F.transform_keys(held, lambda k, _: F.lower(k))
    field = lambda name: F.try_element_at(held, F.lit(name.lower())).try_cast("double")
    depth = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
    kind = F.get_json_object("geometry", "$.type")
    coords = F.get_json_object("geometry", "$.coordinates")
    parts = []
    for name, d in depth.items():
        value = F.from_json(coords, "array<" * (d + 1) + "double" + ">" * (d + 1))
        for _ in range(max(0, d - 1)):
            value = F.flatten(value)
        value = F.array(value) if d == 0 else value
        parts.append(F.when(kind == name, value))
    z = F.coalesce(*[field(n) for n in ([z_field] if z_field else Z_FIELDS)])
    w = F.coalesce(field(weight_field), F.lit(1.0)) if weight_field else F.lit(1.0)
    u = F.coalesce(field(uncertainty_field), F.lit(0.0)) if uncertainty_field else F.lit(0.0)
    out = features.select(F.explode(F.coalesce(*parts)).alias("v"), z.alias("fz"), w.alias("w"), u.alias("u"))
    height = F.coalesce(F.get("v", F.lit(2)), "fz", F.lit(elevation).cast("double")) * z_scale
    return out.select(F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), height.alias("z"), "w", "u").filter("z IS NOT NULL")


def _known_layer(features: DataFrame) -> DataFrame:
    """The features of the first of `LAYERS` that any of them belongs to by their property "layer"; all of them, if none does."""
    rank = F.coalesce(*[F.when(F.get_json_object("properties", "$.layer") == name, i) for i, name in enumerate(LAYERS)])
    ranked = features.withColumn("_rank", rank)
    best = ranked.agg(F.min("_rank").alias("_best"))  # one row
    return ranked.crossJoin(F.broadcast(best)).filter("_best IS NULL OR _rank = _best").drop("_rank", "_best")


def read_geojson(spark: SparkSession, path, layers=None, nesting: int = 8, **options) -> DataFrame:
    """Vertices of the features of GeoJSON files; geometry collections are opened, up to `nesting` of them in one another, and a deeper one is an error.
    `layers`: only features whose property "layer" is listed (any, if empty); if None, those of a known layer. A file may be one collection, which goes to one
    task, or (.geojsonl) a feature a line, which is split among tasks."""
    if str(path).endswith(("geojsonl", "geojsons")):
        rows = spark.read.text(path).select(F.get_json_object("value", "$.geometry").alias("geometry"), F.get_json_object("value", "$.properties").alias("properties"))
    else:
        whole = spark.read.text(path, wholetext=True)
        rows = whole.select(F.inline(F.from_json(F.get_json_object("value", "$.features"), "array<struct<geometry:string,properties:string>>")))
    if layers is None:
        rows = _known_layer(rows)
    elif layers:
        rows = rows.filter(F.get_json_object("properties", "$.layer").isin(list(layers)))
    inner = F.from_json(F.get_json_object("geometry", "$.geometries"), "array<string>")
    collection = F.coalesce(F.get_json_object("geometry", "$.type") == "GeometryCollection", F.lit(False))
    for _ in range(nesting):
        rows = rows.select(F.explode(F.when(collection, inner).otherwise(F.array("geometry"))).alias("geometry"), "properties")
    deep = F.raise_error(F.lit(f"{path}: collections nested deeper than {nesting}")).cast("string")
    return vertices(rows.select(F.when(collection, deep).otherwise(F.col("geometry")).alias("geometry"), "properties"), **options)


def read_las(spark: SparkSession, path, classes: str = "2/29/40") -> DataFrame:
    """Points of uncompressed LAS files whose class is listed (any, if empty); w is 1 and u is 0. A file goes to one task; `las.LasRecords` splits
    files by records, where all executors mount their folder."""
    wanted = [int(c) for c in classes.split("/") if c]

    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                layout = Layout.of(raw[:HEADER])
                if layout is None:
                    continue
                xyz, klass = layout.points(raw, layout.count, layout.start)
                xyz = xyz[np.isin(klass, wanted)] if wanted else xyz
                for i in range(0, len(xyz), 100_000):
                    x, y, z = xyz[i : i + 100_000].T
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (x, y, z)], names=["x", "y", "z"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "x double, y double, z double").withColumn("w", F.lit(1.0)).withColumn("u", F.lit(0.0))


def _by_file(spark: SparkSession, path, look, kind: str, name: str) -> DataFrame:
    """(path, name) of files: what `look` finds in each, an opened file. Contents are not loaded; a task reads what it asks for."""

    def run(batches):
        for b in batches:
            found = []
            for uri in b.column(0).to_pylist():
                with opened(uri) as f:
                    found.append(look(f))
            yield pa.RecordBatch.from_pydict({"path": b.column(0), name: pa.array(found, pa.string() if kind == "string" else pa.bool_())})

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, f"path string, {name} {kind}")


def las_srs(spark: SparkSession, path) -> DataFrame:
    """(path, srs) of LAS files: the reference system that each names in the records before or after its points, null where it names none. Only
    those records are read, whatever their size."""
    return _by_file(spark, path, reference_system_of, "string", "srs")


def cells_to_points(cells: DataFrame, grid: GridSpec, weight: str | None = None, uncertainty: str | None = None, mask: str | None = None) -> DataFrame:
    """Points at the centres of the cells with data; a mask of 0 leaves a cell out."""
    out = cells.filter(F.col("z").isNotNull() & ~F.isnan("z"))
    out = out.filter(F.col(mask) != 0) if mask else out
    w = F.col(weight) if weight else F.lit(1.0)
    u = F.col(uncertainty) if uncertainty else F.lit(0.0)
    return grid.centres(out).select("x", "y", "z", w.alias("w"), u.alias("u"))


def window_of(grid: GridSpec, region: Region) -> tuple[tuple[int, int], tuple[int, int]]:
    """The first and last row, and the first and last column, of the cells whose inside a region meets, cut to the grid."""

    def ends(low: float, high: float, inc: float, n: int) -> tuple[int, int]:
        return max(0, math.floor(low / inc)), min(n, math.ceil(high / inc)) - 1

    r = grid.region
    return ends(r.n - region.n, r.n - region.s, grid.yinc, grid.rows), ends(region.w - r.w, region.e - r.w, grid.xinc, grid.cols)


def read_cells(spark: SparkSession, path, grid: GridSpec, region: Region | None = None) -> DataFrame:
    """A columnar table of cells; of a region only the cells that it meets, by filters that reach the scan."""
    cells = spark.read.parquet(path)
    if region is None:
        return cells
    rows, cols = window_of(grid, region)
    return cells.filter(F.col("row").between(*rows) & F.col("col").between(*cols))


def read_columnar(spark: SparkSession, path) -> DataFrame:
    """A columnar point file; x is mandatory."""
    rows = spark.read.parquet(path)
    if "x" not in rows.columns:
        raise ValueError(f"{path}: no column x")
    return rows


def read_points(
    spark: SparkSession, path: str | list[str], data_type: str | None = None, weight: float = 1.0, uncertainty: float = 0.0, src_srs: str | int | None = None, dst_srs: str | int = "geographic", **options,
) -> DataFrame:
    """Points of any supported file in the standard schema, by data type or else extension; ASCII, LAS and columnar files may be a list of paths. `src_srs`:
    the system that the file's coordinates are in, which then come in `dst_srs`."""
    if data_type in PROFILES:
        rows = read_xyz(spark, path, **PROFILES[data_type] | options)
    elif data_type in VECTOR_PROFILES:
        rows = read_geojson(spark, path, **VECTOR_PROFILES[data_type] | options)
    else:
        kind = EXTENSIONS.get(data_type or str(path).rsplit(".", 1)[-1].lower())
        reader = {"xyz": read_xyz, "geojson": read_geojson, "las": read_las, "columnar": read_columnar}.get(kind)
        if reader is None:
            raise ValueError(f"{path}: no reader for this kind of file")
        rows = reader(spark, path, **options)
    return ensure_schema(rows if src_srs is None else projected(rows, dst_srs, src_srs), weight, uncertainty)


def write_xyz(points: DataFrame, path: str, places: int = 6, delimiter: str = " ", columns=("x", "y", "z", "w", "u")) -> None:
    """ASCII lines of x y z w u, or of other columns, as row col z of binned points."""
    kinds = dict(points.dtypes)
    text = F.format_string(delimiter.join(f"%.{places}f" if kinds[c] in ("double", "float") else "%d" for c in columns), *columns)
    points.select(text.alias("value")).write.text(path)


def write_columnar(points: DataFrame, path: str, grid: GridSpec | None = None, mode: str = "mean", compression: str = "gzip", seq: str = "seq") -> DataFrame:
    """Write points to a columnar file, with a grid as one point a cell (x, y, z, w, u); gives the points back as they were."""
    out = points
    if grid is not None:
        from tidegrid.operators.stacks import point_pixels

        out = point_pixels(points, grid, mode, seq=seq).select("x", "y", "z", F.col("weight").alias("w"), F.col("uncertainty").alias("u"))
    out.write.parquet(path, compression=compression)
    return points


def write_sidecars(datasets: DataFrame, path: str) -> None:
    """A JSON line for every dataset (the columns of `stream_inf`, a bounding polygon, or any others)."""
    datasets.write.json(path)


def write_footprints(datasets: DataFrame, path: str, properties=()) -> None:
    """Bounds (w, e, s, n) of datasets as GeoJSON features by line, which any part of a table may be written to: a polygon each, closed, from the south-west
    corner against the clock, and the named columns as properties. Datasets without bounds are left out."""
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(corner("w", "s"), corner("e", "s"), corner("e", "n"), corner("w", "n"), corner("w", "s"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry")
    held = F.struct(*[F.col(c) for c in properties]).alias("properties") if properties else F.from_json(F.lit("{}"), "struct<dummy:string>").alias("properties")
    rows = datasets.filter("w IS NOT NULL AND e IS NOT NULL AND s IS NOT NULL AND n IS NOT NULL")
    rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry, held)).alias("value")).write.text(path)


def reject_bag(spark: SparkSession, path) -> DataFrame:
    """(path, valid) by the magic number of HDF5, the only bytes that are read; nothing is deleted."""
    return _by_file(spark, path, lambda f: f.read(4) == b"\x89HDF", "boolean", "valid")
