"""Typed dataflow graphs, robust statistics and raster analytics as Spark jobs."""
