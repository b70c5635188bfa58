"""Spark-first analytics over before/after rasters, vector layers, road graphs and text corpora."""
