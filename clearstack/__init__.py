"""Clearstack: analytics over stacks of co-registered raster observations, as Spark DataFrames."""
