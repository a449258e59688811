"""Aggregations of points onto grids and of datasets into metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidegrid.functions.grid import GridSpec, Region
from tidegrid.functions.shared import stash

_CELL = ["row", "col"]


def point_pixels(points: DataFrame, grid: GridSpec, mode: str = "mean", weight: float = 1.0, uncertainty: float = 0.0, seq: str = "seq") -> DataFrame:
    """(row, col, z, x, y, weight, uncertainty, count) of every cell that has points."""
    p = grid.index(points).withColumn("w", F.coalesce("w", F.lit(1.0))).withColumn("u", F.coalesce("u", F.lit(0.0)))
    total = F.sum(F.col("w") * weight)
    value = {
        "mean": lambda c: F.avg(c),
        "min": lambda c: F.min(c),
        "max": lambda c: F.max(c),
        "median": lambda c: F.percentile(c, F.lit(0.5)) if c == "z" else F.avg(c),
        "std": lambda c: F.stddev_pop(c) if c == "z" else F.avg(c),
        "var": lambda c: F.var_pop(c) if c == "z" else F.avg(c),
        "sums": lambda c: F.sum(F.col(c) * F.col("w") * weight),
    }.get(mode, lambda c: F.min_by(c, seq))
    first_u = F.pow(F.min_by("u", seq), F.lit(2))
    spread = F.pow(F.stddev_pop("z"), F.lit(2)) if mode in ("mean", "median", "sums") else F.lit(0.0)
    return p.groupBy(*_CELL).agg(
        value("z").alias("z"), value("x").alias("x"), value("y").alias("y"),
        (total if mode == "sums" else F.min_by("w", seq) * F.count("*") * weight).alias("weight"),
        F.sqrt(first_u + spread + uncertainty * uncertainty).alias("uncertainty"), F.count("*").alias("count"),
    )


def simple_stack(points: DataFrame, grid: GridSpec, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean z of every cell, null where weights are not positive in sum; `by`: further keys, a grid for each."""
    p = grid.index(points).withColumn("w", F.coalesce("w", F.lit(1.0)))
    sums = p.groupBy(*by, *_CELL).agg(F.sum(F.col("z") * F.col("w")).alias("szw"), F.sum("w").alias("sw"))
    return sums.select(*by, *_CELL, F.when(F.col("sw") > 0, F.col("szw") / F.col("sw")).alias("z"))


def partial_stack(points: DataFrame, grid: GridSpec, seq: str = "seq") -> DataFrame:
    """Stage 1 of the statistical stack: sums of each dataset in each cell."""
    p = grid.index(points).withColumn("w", F.coalesce("w", F.lit(1.0))).withColumn("u", F.coalesce("u", F.lit(0.0)))
    w = lambda c: F.sum(F.col(c) * F.col("w"))
    return p.groupBy(*_CELL, "dataset_id").agg(
        F.count("*").alias("n"), F.sum("w").alias("sw"), w("z").alias("sz"), w("x").alias("sx"), w("y").alias("sy"),
        (F.pow(F.min_by("u", seq), F.lit(2)) + F.pow(F.stddev_pop("z"), F.lit(2))).alias("suc2"),
        F.min("z").alias("zmin"), F.max("z").alias("zmax"), F.avg("x").alias("xm"), F.avg("y").alias("ym"),
        F.min_by("u", seq).alias("u0"), F.min(seq).cast("long").alias("seq0"), F.avg("z").alias("zm"), F.var_pop("z").alias("zv"),
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """Partial sums of a dataset that came in several batches as if it had come in one."""
    n = F.sum("n")
    mean = lambda c: (F.sum(F.col("n") * F.col(c)) / n).alias(c)
    # the variance is that within the batches and that of their means
    within, square, level = F.sum(F.col("n") * F.col("zv")) / n, F.sum(F.col("n") * F.col("zm") * F.col("zm")) / n, F.sum(F.col("n") * F.col("zm")) / n
    variance = F.greatest(within + square - level * level, F.lit(0.0))
    return partials.groupBy(*_CELL, "dataset_id").agg(
        n.alias("n"), *[F.sum(c).alias(c) for c in ("sw", "sz", "sx", "sy")], (F.pow(F.min_by("u0", "seq0"), F.lit(2)) + variance).alias("suc2"),
        F.min("zmin").alias("zmin"), F.max("zmax").alias("zmax"), mean("xm"), mean("ym"),
    )


def finish_stack(partials: DataFrame, mode: str = "mean", thresholds=(1.0,), order: str = "ingest_order") -> DataFrame:
    """Stage 2: (row, col, z, count, weights, uncertainty, src_uncertainty, x, y).

    mean adds all datasets; supercede keeps the one of greatest mean weight, the earliest of equals; mixed adds those of the
    highest weight tier in the cell; min and max take the extremes of z of all points, the other columns being those of mean.
    `partials` has a column `order`.
    """
    avg = F.col("sw") / F.col("n")
    if mode == "supercede":
        first = Window.partitionBy(*_CELL).orderBy(F.desc("avg"), order)
        partials = partials.withColumn("avg", avg).filter("avg > 0").withColumn("r", F.row_number().over(first)).filter("r = 1")
    elif mode == "mixed":
        tier = F.lit(0)
        for t in sorted(thresholds):
            tier = tier + (avg >= t).cast("int")
        partials = partials.withColumn("tier", tier).withColumn("top", F.max("tier").over(Window.partitionBy(*_CELL))).filter("tier = top")
    sums = partials.groupBy(*_CELL).agg(
        *[F.sum(c).alias(c) for c in ("n", "sw", "sz", "sx", "sy", "suc2")], F.min("zmin").alias("zmin"), F.max("zmax").alias("zmax")
    )
    part = lambda c: F.try_divide(F.col(c), F.col("sw"))
    z = F.col(f"z{mode}") if mode in ("min", "max") else part("sz")
    return sums.select(
        *_CELL, z.alias("z"), F.col("n").alias("count"), F.col("sw").alias("weights"),
        (F.sqrt("suc2") / F.col("n")).alias("uncertainty"), F.lit(0.0).alias("src_uncertainty"), part("sx").alias("x"), part("sy").alias("y"),
    )


def multi_stack(points: DataFrame, datasets: DataFrame, grid: GridSpec, mode: str = "mean", thresholds=(1.0,), seq: str = "seq") -> DataFrame:
    """The statistical stack of points of catalogued datasets (dataset_id, ingest_order)."""
    partials = partial_stack(points, grid, seq).join(datasets.select("dataset_id", "ingest_order"), "dataset_id")
    return finish_stack(partials, mode, thresholds)


def provenance(points: DataFrame, datasets: DataFrame, grid: GridSpec) -> DataFrame:
    """(row, col, mask): bit k is set where the module of rank k by first ingest has points. A mask has 63 bits; a catalog of more
    modules is an error."""
    modules = provenance_legend(datasets).select("module", "bit")
    bits = datasets.select("dataset_id", "module").join(modules, "module").select("dataset_id", "bit")
    present = grid.index(points).select("dataset_id", *_CELL).distinct().join(bits, "dataset_id")
    return present.groupBy(*_CELL).agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))


def provenance_legend(datasets: DataFrame) -> DataFrame:
    """(module, bit, value): the bit of each module's mask, by first ingest."""
    modules = datasets.groupBy("module").agg(F.min("ingest_order").alias("first"))
    rank = F.row_number().over(Window.orderBy("first", "module")) - 1  # a row per module
    bit = F.when(rank > 62, F.raise_error(F.lit("more than 63 modules do not fit a mask")).cast("int")).otherwise(rank)
    return modules.select("module", bit.alias("bit")).withColumn("value", F.expr("shiftleft(1L, bit)"))


def source_masks(points: DataFrame, grid: GridSpec) -> DataFrame:
    """(dataset_id, row, col) of every cell that a dataset has points in."""
    return grid.index(points).select("dataset_id", *_CELL).distinct()


def stream_inf(points: DataFrame) -> DataFrame:
    """Count and bounds of every dataset; `bounds_wkt` makes a polygon of them."""
    ends = [f(c).alias(f"{c}{n}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    return points.groupBy("dataset_id").agg(F.count("*").alias("numpts"), *ends)


def bounds_wkt(w: str = "xmin", e: str = "xmax", s: str = "ymin", n: str = "ymax"):
    """The bounding polygon of four columns as well-known text, from the south-west corner and back; null where one is null."""
    number = lambda c: F.call_function("format_number", F.col(c), F.lit("0.######"))
    corner = lambda x, y: F.concat(number(x), F.lit(" "), number(y))
    ring = [corner(w, s), corner(w, n), corner(e, n), corner(e, s), corner(w, s)]
    return F.concat(F.lit("POLYGON (("), F.concat(*[x for c in ring for x in (F.lit(", "), c)][1:]), F.lit("))"))


def clean_percent(beams: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Soundings, good ones, and their percentage; `by`: keys, a row for each."""
    good = F.count_if(F.col("beamflag") == 0)
    counts = beams.groupBy(*by).agg(F.count("*").alias("beams"), good.alias("good"))
    return counts.withColumn("percent", F.try_divide(100.0 * F.col("good"), F.col("beams")))


def footprints(points: DataFrame, region: Region) -> DataFrame:
    """West, east, south, north of every dataset, the region's where it has no points with coordinates."""
    b = points.groupBy("dataset_id").agg(F.min("x").alias("w"), F.max("x").alias("e"), F.min("y").alias("s"), F.max("y").alias("n"))
    return b.select("dataset_id", *[F.coalesce(c, F.lit(getattr(region, c))).alias(c) for c in "wesn"])


def coastline_votes(cells: DataFrame, weights: dict[str, float], default: float = 0.1) -> DataFrame:
    """(row, col, vote, land) from gridded datasets (dataset_id, row, col, z): weighted votes, ties are water.

    A positive weight votes for land where z > 0 and against it elsewhere. Another weight votes against land where z > 0
    in a dataset without negative z, a mask, and else votes with its sign.
    """
    known = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    low = cells.groupBy("dataset_id").agg(F.min("z").alias("low"))
    v = cells.join(low, "dataset_id").withColumn("wt", F.coalesce(F.try_element_at(known, F.col("dataset_id")), F.lit(default)))
    sign = F.when(F.col("z") > 0, 1.0).otherwise(-1.0)
    vote = F.when(F.col("wt") > 0, sign * F.col("wt")).when(F.col("low") >= 0, F.when(F.col("z") > 0, -F.abs("wt")).otherwise(0.0)).otherwise(sign * F.col("wt"))
    return v.groupBy(*_CELL).agg(F.sum(vote).alias("vote")).withColumn("land", (F.col("vote") > 0).cast("int"))


def unseen(points: DataFrame, registry: DataFrame) -> DataFrame:
    """Points of datasets that the registry does not have."""
    return points.join(registry.select("dataset_id").distinct(), "dataset_id", "left_anti")


def quantiles(rows: DataFrame, column: str, at: dict[str, float]) -> DataFrame:
    """One row with the exact quantiles `at` by name, between the two nearest ranks; null where the column has no value.

    Equal values are counted before they move; the distinct ones are dealt by range and ranked inside their range, so no task holds
    the column. Only the totals of the ranges, as many as spark.sql.shuffle.partitions, meet in one window.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.select(F.col(column).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    dealt = stash(counts.repartitionByRange(ranges, "v").select("v", "n", F.spark_partition_id().alias("part")), "values")
    totals = dealt.groupBy("part").agg(F.sum("n").alias("m"))
    totals = totals.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("base"), F.sum("m").over(Window.partitionBy()).alias("size"))
    inside = Window.partitionBy("part").orderBy("v")
    # a value has the ranks from `end` - n to `end` - 1
    ranked = dealt.withColumn("end", F.sum("n").over(inside)).join(F.broadcast(totals), "part").withColumn("end", F.col("end") + F.col("base"))
    found = []
    for name, share in at.items():
        rank = F.lit(float(share)) * (F.col("size") - 1)
        held = lambda r: F.max(F.when((r >= F.col("end") - F.col("n")) & (r < F.col("end")), F.col("v")))
        low, high = held(F.floor(rank)), held(F.ceil(rank))
        found.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(name))
    return ranked.agg(*found)


def iqr_fences(rows: DataFrame, column: str = "z", percentile: float = 0.75, k: float = 1.5) -> DataFrame:
    """(lower, upper) outlier fences of a column."""
    q = quantiles(rows, column, {"lo": 1 - percentile, "hi": percentile})
    return q.select((F.col("lo") - k * (F.col("hi") - F.col("lo"))).alias("lower"), (F.col("hi") + k * (F.col("hi") - F.col("lo"))).alias("upper"))


def band_statistics(cells: DataFrame, bands=("z",)) -> DataFrame:
    """A row per band: least, greatest, mean and population deviation."""
    rows = cells.select(F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in bands])))
    return rows.groupBy("band").agg(F.min("v").alias("least"), F.max("v").alias("greatest"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
