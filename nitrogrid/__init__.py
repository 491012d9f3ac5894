"""Gridded air-quality analytics expressed as Spark DataFrame operators."""
