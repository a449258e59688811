"""Sounding lists, their metadata, weights of gridded surveys, and the crawl of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegrid.functions.grid import Region, age_weight, beam_uncertainty, ensure_schema
from tidegrid.operators.filters import beam_quality

#: fixed values: the columns of a sounding list
BEAM_COLUMNS = (
    "x y z crosstrack_distance crosstrack_slope flat_bottom_grazing_angle seafloor_grazing_angle beamflag pitch draft roll heave speed sonar_alt "
    "sonar_depth alongtrack_distance cumulative_alongtrack_distance heading beam_number"
).split()


def read_beams(spark: SparkSession, path, year: str | Column | None = None, filtered: bool = False) -> DataFrame:
    """Soundings of tab-separated lists, with uncertainty u and weight w = age weight / u; `filtered`: good beams only."""
    schema = ", ".join(f"{c} double" for c in BEAM_COLUMNS)
    rows = spark.read.csv(path, schema=schema, sep="\t").filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    rows = beam_quality(rows) if filtered else rows
    u = beam_uncertainty()
    rows = rows.withColumn("_year", F.lit(None).cast("int") if year is None else F.lit(year).cast("int"))
    return rows.withColumn("u", u).withColumn("w", F.when(F.col("u") > 0, 1 / F.col("u")).otherwise(1.0) * age_weight("_year")).drop("_year")


def read_beam_metadata(spark: SparkSession, path) -> DataFrame:
    """(path, format, year, good_percent) of the text metadata beside sounding files; null where a file does not say."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"))
    word = lambda i: F.get(F.split("line", r"\s+"), F.lit(i))
    good = F.regexp_extract("line", r"^Number of Good Beams\s*:.*?([0-9.]+)%?\s*$", 1)
    return lines.groupBy("path").agg(
        F.max(F.when(F.col("line").startswith("MBIO"), word(4))).alias("format"),
        F.max(F.when(F.col("line").startswith("Time:"), F.regexp_extract("line", r"\b(\d{4})\b", 1).try_cast("int"))).alias("year"),
        F.max(F.when(good != "", good).try_cast("double")).alias("good_percent"),
    )


def select_surveys(metadata: DataFrame, min_year: int | None = None, formats: tuple[str, ...] = (), least_good: float | None = None) -> DataFrame:
    """Of listed sounding files (`read_beam_metadata`) those of `min_year` or later, of one of `formats`, and with `least_good` percent of good beams; what a file does not say
    does not leave it out."""
    keep = F.lit(True)
    if min_year is not None:
        keep = keep & F.coalesce(F.col("year") >= min_year, F.lit(True))
    if formats:
        keep = keep & F.coalesce(F.col("format").isin(list(formats)), F.lit(True))
    if least_good is not None:
        keep = keep & F.coalesce(F.col("good_percent") >= least_good, F.lit(True))
    return metadata.filter(keep)


def read_surveys(spark: SparkSession, metadata: DataFrame, extension: str = ".txt", region: Region | None = None, filtered: bool = False) -> DataFrame:
    """Soundings of the lists that lie beside the chosen files' metadata (the same name with `extension` in place of .inf), each with the weight of its year, cropped to a
    region if one is given, with the `path` of its list."""
    chosen = metadata.select(F.regexp_replace("path", r"\.inf$", extension).alias("path"), "year")
    paths = [r["path"] for r in chosen.collect()]
    schema = ", ".join(f"{c} double" for c in BEAM_COLUMNS)
    if not paths:
        return spark.createDataFrame([], f"{schema}, u double, w double, path string")
    rows = spark.read.csv(paths, schema=schema, sep="\t").withColumn("path", F.col("_metadata.file_path")).filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    rows = rows.filter(region.contains()) if region else rows
    rows = (beam_quality(rows) if filtered else rows).join(F.broadcast(chosen), "path")  # its paths are held above
    rows = rows.withColumn("u", beam_uncertainty())
    return rows.withColumn("w", F.when(F.col("u") > 0, 1 / F.col("u")).otherwise(1.0) * age_weight("year")).drop("year")


def gridded_weight(res: Column | float, least: float = 0.0) -> Column:
    """Weight of a gridded survey by its cell size: tenfold where that is 3 or less, 1 where it is 0."""
    r = F.lit(res).cast("double")
    w = F.try_divide(3 * F.when(r <= 3, 10.0).otherwise(1.0), r)
    return F.when(r == 0, 1.0).otherwise(F.greatest(w, F.lit(float(least))))


def dataset_id(checksum: str = "checksum", url: str = "url", name: str = "name", size: str = "size") -> Column:
    """Identity of a dataset: its checksum, else a remote address, else name and size, else the name."""
    remote = F.when(F.col(url).contains("://") & ~F.col(url).startswith("file://"), F.col(url))
    sized = F.when(F.col(size).isNotNull(), F.concat_ws("|", F.col(name), F.concat(F.col(size).cast("string"), F.lit("B"))))
    return F.coalesce(F.col(checksum), remote, sized, F.col(name))


def crawl(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """(path, length, modified) of all files below a folder with this extension; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def gridded_surveys(files: DataFrame, path: str = "path") -> DataFrame:
    """Of listed files of gridded surveys those whose heights are not above the ellipsoid, by their names."""
    return files.filter(~F.col(path).contains("_Ellipsoid_"))


def bounds_meet(region: Region, w: str = "w", e: str = "e", s: str = "s", n: str = "n") -> Column:
    """Whether a dataset's bounds touch a region."""
    return (F.col(e) >= region.w) & (F.col(w) <= region.e) & (F.col(n) >= region.s) & (F.col(s) <= region.n)


def read_many(readers: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """The points of several sources in the standard schema, a weight for each."""
    parts = [ensure_schema(r, w) for r, w in zip(readers, weights or [1.0] * len(readers), strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
