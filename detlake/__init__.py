"""Detection-data analytics on Spark: boxes, polygons, tracks, labels and metrics as DataFrames."""

__version__ = "0.1.0"
