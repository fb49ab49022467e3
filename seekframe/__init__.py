"""Seekframe: hybrid full-text search and text analytics as PySpark DataFrame transformations."""
