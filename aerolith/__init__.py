"""Hourly air-quality analytics on Spark: DataFrame in, DataFrame out."""
