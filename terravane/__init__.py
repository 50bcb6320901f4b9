"""Spark-native analytics for environmental rasters, zones, points and series."""
