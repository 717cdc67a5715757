"""Grouped-measurement analytics on Spark: DataFrame in, DataFrame out."""
