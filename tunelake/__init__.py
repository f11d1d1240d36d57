"""Listening analytics on Spark: typed loads, staged models, daily marts and data checks."""
