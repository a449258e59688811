"""Elevation points and grids as Spark DataFrames."""
