"""Canned chains from points to grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidegrid.functions.grid import GridSpec, ensure_schema
from tidegrid.operators import filters, stacks
from tidegrid.sources.surveys import read_many


def land_surface(points: DataFrame, grid: GridSpec, min_z: float = 0.01) -> DataFrame:
    """A land surface: heights under `min_z` go."""
    return stacks.simple_stack(filters.drop_class(filters.range_z(ensure_schema(points), min_z), "7"), grid)


def checked_surface(points: DataFrame, grid: GridSpec, reference: DataFrame, value: str, threshold: float, mode: str = "diff") -> DataFrame:
    """Points too far from a reference surface go: 50 by difference for bare-earth models, 5 percent for soundings."""
    flagged = filters.rq(ensure_schema(points), reference, grid, value, threshold, mode)
    return stacks.simple_stack(filters.drop_class(flagged, "7"), grid)


def source_surface(sources: list[DataFrame], grid: GridSpec, weights: list[float] | None = None, pad: int = 10) -> DataFrame:
    """A surface of several sources, a weight for each, cropped to the grid and `pad` cells around it."""
    area = grid.region.buffer(pad * max(grid.xinc, grid.yinc))
    return stacks.simple_stack(read_many([filters.spatial_crop(s, area) for s in sources], weights), grid)


def coast(sources: dict[str, DataFrame], grid: GridSpec, weights: dict[str, float], default: float = 0.1) -> DataFrame:
    """(row, col, vote, land) from points of several sources by name: each is gridded by itself and votes with its weight."""
    named = [stacks.simple_stack(ensure_schema(s), grid).select(F.lit(name).alias("dataset_id"), "row", "col", "z") for name, s in sources.items()]
    return stacks.coastline_votes(reduce(DataFrame.unionByName, named), weights, default)
