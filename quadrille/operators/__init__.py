"""Operators on pixel, window, polygon and object tables."""
