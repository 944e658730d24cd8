"""Raster and vector files, feature tables and artifacts."""
