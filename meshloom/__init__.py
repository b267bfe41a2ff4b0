"""Mesh analytics on Spark: meshes are DataFrames, mesh questions are Spark plans."""

__version__ = "0.1.0"
