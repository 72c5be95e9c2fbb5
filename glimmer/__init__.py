"""Spark-first extraction of sources from movies and time series."""
