"""Spark-first raster, vector and corpus analytics."""
