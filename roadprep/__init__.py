"""Spark jobs for object-detection datasets."""
